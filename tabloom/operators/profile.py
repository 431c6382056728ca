"""Profile of a raw table and the trim rules built on it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import INTEGER_TYPES, of_kind, per_column, q, quoted

MISSING_LIMIT = 0.5
CONSTANT_LIMIT = 0.99
TEXT_ID_LIMIT = 0.70
NAMED_ID_LIMIT = 0.50
CLASS_LIMIT = 20
# the distinct sketch (2^14 registers) has a standard error below 1%; whatever lies within five
# times that of a limit is counted exactly
SKETCH_LOG_SIZE = 14
SKETCH_MARGIN = 0.05
# frequent-item sketch size; its error (< 0.5% of rows) cannot hide a value above 99%
TOP_K_ITEMS = 1000


@dataclass
class ColumnProfile:
    column: str
    n_rows: int
    n_null: int
    top_count: int  # exact when it decides the near-constant rule, else a sketch's bound
    n_distinct: int  # exact when it decides an identifier rule, else estimated
    exact_distinct: bool


def missing_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_null, null_ratio, dropped)"""
    stats = per_column(
        df,
        columns or df.columns,
        {"n_rows": lambda c: F.count("*"), "n_null": lambda c: F.count_if(q(c).isNull())},
    )
    ratio = F.col("n_null") / F.nullif(F.col("n_rows").cast("double"), F.lit(0.0))
    return stats.withColumn("null_ratio", ratio).withColumn("dropped", ratio > MISSING_LIMIT)


def _candidates(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """One pass: nulls, the likely most common value and a distinct estimate of every column."""
    cells = [F.count("*").alias("n_rows")]
    for i, c in enumerate(columns):
        cells += [
            F.count_if(q(c).isNull()).alias(f"null_{i}"),
            F.expr(f"approx_top_k({quoted(c)}, 1, {TOP_K_ITEMS})").alias(f"top_{i}"),
            F.hll_sketch_estimate(
                F.hll_sketch_agg(F.when(q(c).isNotNull(), F.xxhash64(q(c))), SKETCH_LOG_SIZE)
            ).alias(f"distinct_{i}"),
        ]
    row = df.agg(*cells).first()
    out = {}
    for i, c in enumerate(columns):
        top = row[f"top_{i}"]
        out[c] = {
            "n_rows": row["n_rows"],
            "n_null": row[f"null_{i}"],
            "item": top[0]["item"] if top else None,
            "top": top[0]["count"] if top else 0,
            "distinct": row[f"distinct_{i}"] or 0,
        }
    return out


def top_value_shares(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, int]]:
    """Column -> (rows, nulls, exact count of the most common value if it is above 98%).

    Null counts as a value. Columns whose sketched top share is below 98% keep the estimate:
    they are certain to pass the 99% rule.
    """
    found = _candidates(df, columns)
    _exact_tops(df, found)
    return {c: (f["n_rows"], f["n_null"], f["top"]) for c, f in found.items()}


def _exact_tops(df: DataFrame, found: dict[str, dict]) -> None:
    close = [c for c, f in found.items() if f["n_rows"] and f["top"] > 0.98 * f["n_rows"]]
    if not close:
        return
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(
        *[
            F.count_if(q(c).eqNullSafe(F.lit(found[c]["item"]).cast(types[c]))).alias(f"top_{i}")
            for i, c in enumerate(close)
        ]
    ).first()
    for i, c in enumerate(close):
        found[c]["top"] = row[i]


def near_constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c, (n, _, top) in top_value_shares(df, columns).items() if n and top / n > CONSTANT_LIMIT]


def id_rule(
    column: str, dtype: T.DataType, n_distinct: int, n_rows: int, key_cols: list[str]
) -> str | None:
    """The first identifier rule that fires, in order."""
    ratio = n_distinct / n_rows if n_rows else 0.0
    if column in key_cols:
        return "user_key"
    if isinstance(dtype, T.StringType) and ratio > TEXT_ID_LIMIT:
        return "unique_text"
    if isinstance(dtype, INTEGER_TYPES) and n_distinct == n_rows:
        return "unique_integer"
    if "id" in column.lower() and ratio > NAMED_ID_LIMIT:
        return "named_id"
    return None


def _needs_exact(column: str, dtype: T.DataType, estimate: int, n_rows: int) -> bool:
    """Could the sketch's error change which identifier rule fires?"""
    ratio = estimate / n_rows if n_rows else 0.0

    def close(limit: float) -> bool:
        return abs(ratio - limit) <= limit * SKETCH_MARGIN

    if isinstance(dtype, T.StringType) and close(TEXT_ID_LIMIT):
        return True
    if isinstance(dtype, INTEGER_TYPES) and ratio >= 1.0 - SKETCH_MARGIN:
        return True
    return "id" in column.lower() and close(NAMED_ID_LIMIT)


def _exact_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.count_distinct(q(c)).alias(f"d_{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


def profile(df: DataFrame, columns: list[str], key_cols: list[str] = ()) -> dict[str, ColumnProfile]:
    """Two or three aggregates for the whole table, whatever its width."""
    found = _candidates(df, columns)
    _exact_tops(df, found)
    types = {f.name: f.dataType for f in df.schema.fields}
    unsure = [
        c
        for c, f in found.items()
        if c not in key_cols and _needs_exact(c, types[c], f["distinct"], f["n_rows"])
    ]
    exact = _exact_distinct(df, unsure)
    return {
        c: ColumnProfile(
            c, f["n_rows"], f["n_null"], f["top"], exact.get(c, f["distinct"]), c in exact
        )
        for c, f in found.items()
    }


def id_like_table(df: DataFrame, key_cols: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """(column, rule): which identifier rule, if any, removes each column."""
    columns = [c for c in df.columns if c not in skip]
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = [
        (c, id_rule(c, types[c], p.n_distinct, p.n_rows, list(key_cols)))
        for c, p in profile(df, columns, list(key_cols)).items()
    ]
    return df.sparkSession.createDataFrame(rows, "column string, rule string")


@dataclass
class TrimReport:
    rows_in: int = 0
    rows_out: int = 0
    high_missing: list[str] = field(default_factory=list)
    near_constant: list[str] = field(default_factory=list)
    id_like: list[str] = field(default_factory=list)
    leakage: list[str] = field(default_factory=list)

    @property
    def dropped(self) -> list[str]:
        return self.high_missing + self.near_constant + self.id_like + self.leakage

    def to_dict(self) -> dict:
        return asdict(self)


def plan_trim(
    df: DataFrame,
    target: str,
    key_cols: list[str] = (),
    leakage_cols: list[str] = (),
    keep_cols: list[str] = (),
    internal: list[str] = (),
) -> TrimReport:
    """Decide which columns of an already deduplicated table go, without changing it."""
    skip = {target, *internal}
    columns = [c for c in df.columns if c not in skip]
    types = {f.name: f.dataType for f in df.schema.fields}
    profiles = profile(df, columns, list(key_cols))
    n = next(iter(profiles.values())).n_rows if profiles else df.count()
    if n == 0:
        raise ValueError("the table has no rows left after removing duplicates")
    report = TrimReport(rows_out=n)
    for c in columns:
        p = profiles[c]
        if c in keep_cols:
            continue
        if p.n_null / n > MISSING_LIMIT:
            report.high_missing.append(c)
        elif p.top_count / n > CONSTANT_LIMIT:
            report.near_constant.append(c)
        elif id_rule(c, types[c], p.n_distinct, n, list(key_cols)):
            report.id_like.append(c)
    # declared keys lead the list of identifiers, the rest follow in table order
    report.id_like.sort(key=lambda c: c not in key_cols)
    gone = set(report.dropped)
    report.leakage = [c for c in leakage_cols if c in columns and c not in gone]
    if len(columns) == len(report.dropped):
        raise ValueError("no feature column is left after trimming")
    return report


def trim(
    df: DataFrame,
    target: str,
    key_cols: list[str] = (),
    leakage_cols: list[str] = (),
    keep_cols: list[str] = (),
    order_by: list[str] | None = None,
) -> tuple[DataFrame, TrimReport]:
    """Deduplicate, then drop sparse, near-constant, identifier-like and leaky columns."""
    from .rows import dedup_by_key, dedup_rows

    of_kind(df, skip=[target])  # refuses unsupported feature types by name
    rows_in = df.count()
    unique = dedup_by_key(df, list(key_cols), order_by) if key_cols else dedup_rows(df)
    report = plan_trim(unique, target, key_cols, leakage_cols, keep_cols)
    report.rows_in = rows_in
    return unique.drop(*report.dropped), report


def trim_log(report: TrimReport) -> list[tuple[str, str, str, str]]:
    """(phase, action, column, value) rows of the decision log."""
    rows = [("trim", "duplicates_removed", None, str(report.rows_in - report.rows_out))]
    for action in ("high_missing", "near_constant", "id_like", "leakage"):
        rows += [("trim", action, c, None) for c in getattr(report, action)]
    return rows
