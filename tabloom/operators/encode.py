"""Target encoding, one-hot encoding, scaling and column alignment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import fresh_names, per_column, q, replace_columns
from .categories import CategoryStats
from .outliers import FLAG

ONE_HOT_LIMIT = 10


def target_encoding_table(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, value, encoding); see CategoryStats.encodings."""
    return CategoryStats.of(df, columns, target).encodings().drop("grand")


def one_hot(column: str, levels: list[str]) -> dict[str, Column]:
    """One 0/1 column per level; a value never seen is all zeros."""
    return {f"{column}_{v}": (q(column) == F.lit(v)).cast("double") for v in levels}


@dataclass
class Encoder:
    numbers: list[str] = field(default_factory=list)
    target_encoded: dict[str, dict[str, float]] = field(default_factory=dict)
    grand_mean: float = 0.0
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    taken: list[str] = field(default_factory=list)

    @property
    def hot_names(self) -> dict[str, list[str]]:
        """`{column}_{level}` per level, numbered where it would clash with any other column."""
        wanted = [f"{c}_{v}" for c, levels in self.one_hot.items() for v in levels]
        names = iter(fresh_names(wanted, [*self.numbers, *self.target_encoded, *self.one_hot, *self.taken]))
        return {c: [next(names) for _ in levels] for c, levels in self.one_hot.items()}

    @property
    def outputs(self) -> list[str]:
        return [*self.numbers, *self.target_encoded, *(n for names in self.hot_names.values() for n in names)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Literal lookups only: after rare folding a column has at most 101 trained values."""
        new: dict[str, Column] = {}
        for c, table in self.target_encoded.items():
            pairs = [x for v, e in table.items() for x in (F.lit(v), F.lit(e))]
            new[c] = F.coalesce(F.create_map(*pairs)[q(c)], F.lit(self.grand_mean))
        for c, names in self.hot_names.items():
            new |= dict(zip(names, one_hot(c, self.one_hot[c]).values()))
        return replace_columns(df, new).drop(*self.one_hot)


def fit_encoder(train: DataFrame, numbers: list[str], categories: list[str], target: str, found: DataFrame | None = None) -> Encoder:
    """High-cardinality categories (> 10 values) by target mean, the others one-hot.

    `found` are the encodings of rare-folded columns where they are known already: at most 101 values each.
    """
    state = Encoder(numbers=list(numbers), taken=list(train.columns))
    if not categories:
        return state
    if found is None:
        found = CategoryStats.of(train, categories, target).encodings()
    tables: dict[str, dict[str, float]] = {c: {} for c in categories}
    for r in found.orderBy("column", "value").collect():
        tables[r["column"]][r["value"]] = r["encoding"]
        state.grand_mean = float(r["grand"] or 0.0)
    for c in categories:
        if len(tables[c]) > ONE_HOT_LIMIT:
            state.target_encoded[c] = tables[c]
        else:
            state.one_hot[c] = sorted(tables[c])
    return state


def scale_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std)"""
    return per_column(
        df, columns, {"mean": lambda c: F.avg(q(c).cast("double")), "std": lambda c: F.stddev_samp(q(c).cast("double"))}
    )


@dataclass
class Scaler:
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (q(c) - F.lit(m)) / F.lit(self.stds[c]) for c, m in self.means.items() if c in df.columns}
        return replace_columns(df, scaled).drop(*self.dropped)


def fit_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    """Z-scores of everything but outlier flags; columns without variance are dropped."""
    state = Scaler()
    columns = [c for c in columns if not c.startswith(FLAG)]
    if not columns:
        return state
    for r in scale_table(train, columns).collect():
        if r["std"] == 0:
            state.dropped.append(r["column"])
        elif r["std"] is not None and r["std"] > 0:
            state.means[r["column"]], state.stds[r["column"]] = r["mean"], r["std"]
    return state


def align(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the trained features in order; absent ones are 0."""
    return df.select(
        *[q(c) for c in keep],
        *[(q(c) if c in df.columns else F.lit(0.0)).cast("double").alias(c) for c in features],
    )
