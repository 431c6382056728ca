"""Row-level cleaning: null targets, duplicates, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import q
from ..functions.hashing import null_flags


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(q(target).isNotNull())


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates, nulls equal. Map-side partial aggregation absorbs hot copies."""
    return df.dropDuplicates()


def dedup_by_key(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Keep the first row of every key; unknown keys are ignored.

    Without `order_by` the row with the smallest content hash stands for its group: any one row,
    but always the same. The rank filter is pushed below the shuffle as a group limit, so each
    map task sends at most one row per key however hot the key is.
    """
    known = [c for c in keys if c in df.columns]
    if not known:
        return dedup_rows(df)
    if order_by:
        order = [q(c) for c in order_by]
    else:
        content = [null_flags(df.columns), *[q(c) for c in df.columns]]
        order = [F.xxhash64(*content), F.hash(*content)]
    first = Window.partitionBy(*[q(c) for c in known]).orderBy(*order)
    return (
        df.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == 1).drop("_nth")
    )


def drop_columns(df: DataFrame, columns: list[str], keep: str | None = None) -> DataFrame:
    """Drop by name, ignoring absent names and never the column to keep (the target)."""
    return df.drop(*[c for c in columns if c in df.columns and c != keep])


def union_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """One table out of a train and a test table held apart."""
    return train.withColumn("_split", F.lit("train")).unionByName(
        test.withColumn("_split", F.lit("test"))
    )
