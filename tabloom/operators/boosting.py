"""AdaBoost: SAMME for classes, R2 for numbers, over weighted MLlib trees.

Row weights live in one log-weight column that grows by one expression per round; the frame is
checkpointed in the shared folder every few rounds so that plans stay short.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.trees import tree_column, tree_rules
from ..session import cut_lineage

CHECKPOINT_EVERY = 10


def _start(train: DataFrame) -> DataFrame:
    return train.select(
        "features", "_label", vector_to_array("features").alias("_x"), F.lit(0.0).alias("_log_w")
    )


def _reweighted(work: DataFrame, change: Column, round_no: int) -> DataFrame:
    work = work.withColumn("_log_w", F.col("_log_w") + change)
    return cut_lineage(work) if round_no % CHECKPOINT_EVERY == 0 else work


def fit_samme(
    train: DataFrame, n_classes: int, rounds: int = 50, rate: float = 1.0, seed: int = 42
) -> list[tuple[float, dict]]:
    """(weight, stump) pairs."""
    work, found = _start(train), []
    for i in range(1, rounds + 1):
        weighted = work.withColumn("_weight", F.exp("_log_w"))
        stump = DecisionTreeClassifier(
            featuresCol="features", labelCol="_label", weightCol="_weight", maxDepth=1, seed=seed + i
        ).fit(weighted)
        rules = tree_rules(stump)
        miss = tree_column(rules, F.col("_x")) != F.col("_label")
        sums = weighted.agg(
            F.count("*").alias("n"),
            F.sum("_weight").alias("all"),
            F.sum(F.when(miss, F.col("_weight")).otherwise(0.0)).alias("missed"),
        ).first()
        error = sums["missed"] / sums["all"]
        if error <= 0:
            found.append((1.0, rules))
            break
        if error >= 1 - 1 / n_classes:
            if not found:
                raise ValueError("the first stump is no better than chance")
            break
        weight = rate * (math.log((1 - error) / error) + math.log(n_classes - 1))
        found.append((weight, rules))
        if i == rounds:
            break
        # keep the mean weight at 1
        scale = (sums["all"] - sums["missed"] + sums["missed"] * math.exp(weight)) / sums["n"]
        change = F.when(miss, weight).otherwise(0.0) - F.lit(math.log(scale))
        work = _reweighted(work, change, i)
    return found


def samme_probability(trees: list[tuple[float, dict]], n_classes: int, values: Column) -> Column:
    """Softmax of the weighted votes."""
    total = sum(w for w, _ in trees)
    predictions = [(w, tree_column(r, values)) for w, r in trees]
    raw = []
    for c in range(n_classes):
        score = F.lit(0.0)
        for w, p in predictions:
            score = score + F.when(p == float(c), w).otherwise(-w / (n_classes - 1))
        raw.append(F.exp(score / total / (n_classes - 1)))
    scores = F.array(*raw)
    sums = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scores, lambda x: x / sums)


def fit_r2(
    train: DataFrame, rounds: int = 50, rate: float = 1.0, depth: int = 3, seed: int = 42
) -> list[tuple[float, dict]]:
    """(weight, tree) pairs with linear loss."""
    work, found = _start(train), []
    for i in range(1, rounds + 1):
        weighted = work.withColumn("_weight", F.exp("_log_w"))
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="_label", weightCol="_weight", maxDepth=depth, seed=seed + i
        ).fit(weighted)
        rules = tree_rules(tree)
        gap = F.abs(F.col("_label") - tree_column(rules, F.col("_x")))
        sums = weighted.agg(
            F.count("*").alias("n"), F.sum("_weight").alias("all"), F.sum(gap * F.col("_weight")).alias("gaps"), F.max(gap).alias("worst")
        ).first()
        if not sums["worst"]:
            found.append((1.0, rules))
            break
        loss = sums["gaps"] / sums["worst"] / sums["all"]
        if loss >= 0.5:
            if not found:
                found.append((1.0, rules))
            break
        beta = loss / (1 - loss)
        found.append((rate * math.log(1 / beta), rules))
        if i == rounds:
            break
        change = (1 - gap / sums["worst"]) * (rate * math.log(beta)) - F.lit(math.log(sums["all"] / sums["n"]))
        work = _reweighted(work, change, i)
    return found


def weighted_median(trees: list[tuple[float, dict]], values: Column) -> Column:
    """The smallest tree prediction at which half of the total tree weight is reached."""
    half = sum(w for w, _ in trees) / 2
    pairs = F.array_sort(
        F.array(*[F.struct(tree_column(r, values).alias("p"), F.lit(float(w)).alias("w")) for w, r in trees])
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        reached = acc["sum"] + x["w"]
        return F.struct(
            reached.alias("sum"),
            F.when(acc["at"].isNull() & (reached >= half - 1e-12), x["p"]).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(pairs, start, step, lambda acc: acc["at"])
