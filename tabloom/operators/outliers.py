"""Outlier bounds and flags, rare categories, log transform of skewed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import per_column, q, replace_columns
from ..functions.moments import adjusted_skew
from ..functions.quantiles import quantiles
from ..session import new_path
from .categories import OTHER, CategoryStats
from .impute import SKEW_LIMIT

FLAG = "Is_Massive_"
# rare lists up to this size live in the state as literals, longer ones as a lookup table
INLINE_RARE = 2_000


def iqr_bounds(
    df: DataFrame, columns: list[str], approx: bool = False, rows: int | None = None
) -> dict[str, tuple[float, float]]:
    """Tukey fences; columns whose quartiles coincide get none."""
    out = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75], approx=approx, rows=rows).items():
        if q1 is not None and q3 != q1:
            out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def iqr_table(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """(column, lower, upper)"""
    rows = [(c, lo, hi) for c, (lo, hi) in iqr_bounds(df, columns, approx).items()]
    return df.sparkSession.createDataFrame(rows, "column string, lower double, upper double")


def vip_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, variance, vip): in the top quarter of the column variances."""
    spread = per_column(df, columns, {"variance": lambda c: F.var_samp(q(c).cast("double"))})
    # one row per column of the table
    limit = spread.agg(F.percentile("variance", 0.75).alias("limit"))
    return spread.join(F.broadcast(limit)).select(
        "column", "variance", F.coalesce(F.col("variance") >= F.col("limit"), F.lit(False)).alias("vip")
    )


def rare_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of categories below 1% of the rows."""
    return CategoryStats.of(df, columns).rare()


def clip(value: Column, lower: float, upper: float) -> Column:
    return F.least(F.greatest(value, F.lit(lower)), F.lit(upper))


@dataclass
class Outliers:
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    flags: list[str] = field(default_factory=list)  # source columns
    rare: dict[str, list[str]] = field(default_factory=dict)
    rare_lookup: dict[str, str] = field(default_factory=dict)  # column -> parquet path
    logged: list[str] = field(default_factory=list)

    @property
    def flag_columns(self) -> list[str]:
        return [FLAG + c for c in self.flags]

    def transform(self, df: DataFrame) -> DataFrame:
        """Flag, clip, fold and log in one projection; long rare lists are joined in first."""
        new: dict[str, Column] = {}
        for c in self.rare_lookup:
            df = self._fold_by_lookup(df, c)
        for c in self.flags:
            new[FLAG + c] = (q(c) > F.lit(self.bounds[c][1])).cast("double")
        for c, (lower, upper) in self.bounds.items():
            new[c] = clip(q(c), lower, upper)
        for c in self.logged:
            new[c] = F.log1p(F.greatest(new.get(c, q(c)), F.lit(0.0)))
        for c, values in self.rare.items():
            new[c] = F.when(q(c).isin(values), OTHER).otherwise(q(c))
        return replace_columns(df, new)

    def _fold_by_lookup(self, df: DataFrame, column: str) -> DataFrame:
        """A plain equi-join: Catalyst broadcasts the lookup only if its size allows.

        Every value in it covers under 1% of the training rows, and frequent values find no match,
        so no key of the lookup is hot.
        """
        lookup = df.sparkSession.read.schema("value string").parquet(self.rare_lookup[column])
        lookup = lookup.select(F.col("value").alias("_rare"))
        joined = df.join(lookup, q(column) == F.col("_rare"), "left")
        folded = F.when(F.col("_rare").isNotNull(), OTHER).otherwise(q(column))
        return replace_columns(joined, {column: folded}).drop("_rare")


def rare_values(
    train: DataFrame, columns: list[str], inline: int = INLINE_RARE, stats: CategoryStats | None = None
) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Short rare lists as literals, long ones written as lookup tables."""
    if not columns:
        return {}, {}
    rare = (stats.only(columns).rare() if stats else rare_table(train, columns)).persist()
    try:
        sizes = {r["column"]: r["count"] for r in rare.groupBy("column").count().collect()}
        short = [c for c, n in sizes.items() if n <= inline]
        lists: dict[str, list[str]] = {c: [] for c in short}
        if short:
            for r in rare.where(F.col("column").isin(short)).orderBy("column", "value").collect():
                lists[r["column"]].append(r["value"])
        tables = {}
        for c in sorted(set(sizes) - set(short)):
            tables[c] = new_path(train.sparkSession, "rare")
            rare.where(F.col("column") == c).select("value").write.parquet(tables[c])
        return lists, tables
    finally:
        rare.unpersist()


def fit_outliers(
    train: DataFrame,
    numbers: list[str],
    categories: list[str],
    approx: bool = False,
    rows: int | None = None,
    stats: CategoryStats | None = None,
) -> Outliers:
    state = Outliers(bounds=iqr_bounds(train, numbers, approx, rows))
    if numbers:
        vips = {r["column"] for r in vip_table(train, numbers).where("vip").collect()}
        state.flags = [c for c in numbers if c in vips and c in state.bounds]
    state.rare, state.rare_lookup = rare_values(train, categories, stats=stats)
    if numbers:
        state.logged = skewed_columns(Outliers(bounds=state.bounds).transform(train), numbers)
    return state


def log_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, skew, low, high, logged) of already clipped columns."""
    facts = per_column(
        df,
        columns,
        {
            "skew": lambda c: adjusted_skew(q(c)),
            "low": lambda c: F.min(q(c)),
            "high": lambda c: F.max(q(c)),
        },
    )
    wanted = (F.abs("skew") > SKEW_LIMIT) & (F.col("low") >= 0) & (F.col("high") > F.col("low"))
    return facts.withColumn("logged", F.coalesce(wanted, F.lit(False)))


def skewed_columns(clipped: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    chosen = {r["column"] for r in log_table(clipped, columns).where("logged").collect()}
    return [c for c in columns if c in chosen]
