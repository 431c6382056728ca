"""Forest importances and the elbow cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import new_path
from . import forest

KEEP_SHARE = 0.95


def forest_importances(
    train: DataFrame, features: list[str], classes: int, trees: int = 100, depth: int | None = None, seed: int = 42
) -> DataFrame:
    """(feature, importance) from a forest on the assembled `features` vector and `_label`; `classes` is 0 for numbers."""
    per_node = max(1, int(len(features) ** 0.5)) if classes else 0
    growth = forest.Growth(classes, trees, True, per_node, depth, seed=seed)
    grown = forest.fit(train.drop("_weight"), growth, new_path(train.sparkSession, "importance-forest"), keep=False)
    return grown.importances(train.sparkSession, features)


def elbow_table(importances: DataFrame, top_n: int | None = None) -> DataFrame:
    """(rank, feature, importance, kept): cut at the elbow, keeping 95% of the total at least.

    The windows run over one row per feature.
    """
    ranked = Window.orderBy(F.desc("importance"), F.asc("feature"))
    whole = Window.partitionBy()
    table = (
        importances.withColumn("rank", F.row_number().over(ranked).cast("long"))
        .withColumn("running", F.sum("importance").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.count("*").over(whole))
        .withColumn("low", F.min("importance").over(whole))
        .withColumn("high", F.max("importance").over(whole))
        .withColumn("total", F.sum("importance").over(whole))
    )
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    bend = (F.col("rank") - 1) / F.nullif(F.col("n") - 1, F.lit(0)) + (F.col("importance") - F.col("low")) / spread
    # the sum is compared through the share of all but a rounding error
    reached = F.col("running") / F.nullif(F.col("total"), F.lit(0.0)) >= KEEP_SHARE - 1e-12
    table = (
        table.withColumn("bend", F.round(bend, 12))
        .withColumn("elbow", F.min_by("rank", F.struct("bend", "rank")).over(whole))
        .withColumn("enough", F.min(F.when(reached, F.col("rank"))).over(whole))
    )
    flat = (F.col("n") <= 2) | (F.col("high") <= F.col("low"))
    cut = F.when(flat, F.col("n")).otherwise(F.greatest("elbow", "enough"))
    if top_n is not None:
        cut = F.least(F.lit(top_n), F.col("n"))
    return table.select("rank", "feature", "importance", (F.col("rank") <= cut).alias("kept"))


def elbow_features(importances: DataFrame, top_n: int | None = None) -> list[str]:
    kept = elbow_table(importances, top_n).where("kept").orderBy("rank")
    return [r["feature"] for r in kept.collect()]
