"""Synthetic minority over-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import q
from ..functions.hashing import hash_rank, uniform
from .neighbours import BROADCAST_BYTES, knn

SEVERE_RATIO = 10
NEIGHBOURS = 5


def class_counts(df: DataFrame, label: str) -> dict:
    return {r["label"]: r["n"] for r in df.groupBy(q(label).alias("label")).agg(F.count("*").alias("n")).collect()}


def needs_balancing(counts: dict) -> bool:
    """The ratio is compared rounded to two places."""
    return len(counts) > 1 and round(max(counts.values()) / min(counts.values()), 2) > SEVERE_RATIO


def smote(
    df: DataFrame,
    key: str,
    label: str,
    vector: str,
    k: int = NEIGHBOURS,
    seed: int = 42,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows of `df` plus synthetic ones lifting every class to the largest; adds `_synthetic`.

    Each synthetic row lies between a row and one of its k nearest rows of the same class. Rows
    take turns as seeds in hash order, so each serves equally often (+-1); the neighbour and the
    position on the segment come from hashes of (row, turn). Nothing is grouped by class in one
    task.
    """
    counts = class_counts(df, label)
    if min(counts.values()) <= k:
        raise ValueError("a class has too few rows to interpolate")
    top = max(counts.values())
    out = df.select(q(key), q(label), q(vector)).withColumn("_synthetic", F.lit(False))
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        if n < top:
            rows = df.where(q(label) == F.lit(value)).select(
                q(key).alias("id"), q(vector).alias("vector")
            )
            made = _between(rows, n, top - n, k, seed, broadcast_bytes)
            out = out.unionByName(
                made.select(
                    _own_key(df, key).alias(key),
                    F.lit(value).cast(df.schema[label].dataType).alias(label),
                    q("vector").cast(df.schema[vector].dataType.simpleString()).alias(vector),
                    F.lit(True).alias("_synthetic"),
                )
            )
    return out


def _own_key(df: DataFrame, key: str) -> Column:
    """Text keys are made unique per synthetic row; other keys name the seed row."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.concat("id", F.lit("#"), F.col("turn").cast("string"))
    return F.col("id")


def _between(rows: DataFrame, n: int, wanted: int, k: int, seed: int, broadcast_bytes: int) -> DataFrame:
    """`wanted` points between rows and their neighbours; keeps the seed row's id."""
    near = knn(rows, rows, k, exclude_self=True, broadcast_bytes=broadcast_bytes)
    turns = F.lit(wanted // n) + (F.col("_rank") <= wanted % n).cast("int")
    seeds = (
        hash_rank(rows, "id", seed, rows=n)
        .withColumn("_turns", turns.cast("int"))
        .where("_turns > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("_turns"))))
        .withColumn("_draw", F.concat_ws("/", q("id").cast("string"), q("turn").cast("string")))
        .withColumn("pick", F.floor(uniform(q("_draw"), seed) * k) + 1)
        .withColumn("u", uniform(q("_draw"), seed + 1))
    )
    others = rows.select(q("id").alias("neighbour_id"), q("vector").alias("other"))
    paired = seeds.join(near, (q("id") == q("query_id")) & (q("pick") == q("rank"))).join(others, "neighbour_id")
    step = F.zip_with("vector", "other", lambda a, b: a + F.col("u") * (b - a))
    return paired.select("id", "turn", "u", "neighbour_id", step.alias("vector"))
