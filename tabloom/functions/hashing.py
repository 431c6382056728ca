"""Deterministic, partition-independent randomness derived from row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import sized
from .columns import q


def seeded_md5(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the seeded hash."""
    return F.conv(F.substring(seeded_md5(key, seed), 1, 13), 16, 10).cast("double") / float(2**52)


def null_flags(columns: list[str]) -> Column:
    """Which of the columns are null, as text: Spark's hashes skip nulls, so content hashes need it too."""
    return F.concat(*[F.when(q(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])


def prefix_digits(rows: int, rows_per_bucket: int) -> int:
    """Hex digits of the hash that split `rows` into buckets of about the wanted size."""
    digits = 1
    while rows / 16**digits > rows_per_bucket and digits < 7:
        digits += 1
    return digits


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int,
    by: list[str] | None = None,
    out: str = "_rank",
    rows_per_bucket: int = 100_000,
    rows: int | None = None,
    most: Column | int | None = None,
) -> DataFrame:
    """Exact 1-based rank by (seeded hash, key), within `by` if given.

    No group is ever sorted in one task: rows are ranked inside (group, hash prefix) buckets
    and every bucket is shifted by the size of the buckets before it, so one class holding most
    of the table still spreads over 16^digits tasks. With `most` only ranks up to it are kept,
    and buckets beyond it are left out before anything is shuffled.
    """
    by = by or []
    rows = df.count() if rows is None else rows
    digits = prefix_digits(rows, rows_per_bucket)
    hashed = df.withColumn("_hash", seeded_md5(q(key), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    group = [q(c) for c in by]
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        hashed.groupBy(*group, "_bucket")
        .agg(F.count("*").alias("_size"))
        .select(
            *[q(c).alias(f"_by_{i}") for i, c in enumerate(by)],
            F.col("_bucket").alias("_shift_bucket"),
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"),
        )
    )
    match = F.col("_bucket") == F.col("_shift_bucket")
    for i, c in enumerate(by):
        match = match & q(c).eqNullSafe(F.col(f"_by_{i}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", q(key))
    joined = hashed.join(shifts, match)
    if most is not None:
        most = F.lit(most) if isinstance(most, int) else most
        joined = joined.where(F.col("_shift") < most)
    ranked = (
        joined
        .withColumn(out, F.row_number().over(inside).cast("long") + F.col("_shift"))
        .drop("_hash", "_bucket", "_shift", "_shift_bucket", *[f"_by_{i}" for i in range(len(by))])
    )
    if most is not None:
        ranked = ranked.where(q(out) <= most)
    return sized(ranked, rows)
