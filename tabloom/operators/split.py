"""Train/test split, row sampling and cross-validation folds, all keyed by row hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import q
from ..functions.hashing import hash_rank, seeded_md5

TRAIN, TEST = "train", "test"


def is_test(key: Column, test_size: float, seed: int) -> Column:
    """The first 16 bits of the seeded hash fall below the test share."""
    cutoff = format(int(test_size * 0x10000), "04x")
    return F.substring(seeded_md5(key, seed), 1, 4) < F.lit(cutoff)


def train_test_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, out: str = "_split"
) -> DataFrame:
    """Mark rows; a map-only step that never depends on partitioning or row order."""
    return df.withColumn(out, F.when(is_test(q(key), test_size, seed), TEST).otherwise(TRAIN))


def simple_sample(
    df: DataFrame, key: str, size: int, seed: int = 42, rows: int | None = None
) -> DataFrame:
    """Exactly `size` rows (all, if there are fewer): those with the smallest hashes."""
    return hash_rank(df, key, seed, rows=rows, most=size).drop("_rank")


def stratified_sample(
    df: DataFrame, key: str, label: str, size: int, seed: int = 42
) -> DataFrame:
    """rint(size * n_c / n) rows of every class; tables up to `size` rows pass unchanged."""
    rows = df.count()
    if rows <= size:
        return df
    quota = (
        df.groupBy(q(label).alias("_class"))
        .agg(F.rint(F.lit(float(size)) * F.count("*") / F.lit(rows)).alias("_quota"))
    )
    allowed = df.join(quota, q(label).eqNullSafe(F.col("_class"))).drop("_class")
    return hash_rank(allowed, key, seed, by=[label], rows=rows, most=F.col("_quota")).drop("_rank", "_quota")


def with_folds(
    df: DataFrame, key: str, folds: int, label: str | None = None, seed: int = 42, out: str = "_fold"
) -> DataFrame:
    """Equal-sized folds; within every class when `label` is given."""
    ranked = hash_rank(df, key, seed, by=[label] if label else None)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def safe_fold_count(df: DataFrame, folds: int, label: str | None = None) -> int:
    """At most the size of the smallest class (of the table, without classes), at least two."""
    if label:
        smallest = df.groupBy(q(label)).count().agg(F.min("count")).first()[0] or 0
    else:
        smallest = df.count()
    return min(folds, max(2, int(smallest)))
