"""Metrics, leaderboards and decisions over tables of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import q

NO_SIGNAL, LEAKAGE = 0.05, 0.9999
STAGES = ["baseline", "tuned", "ensemble"]


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n): the only pass over the rows, combined map-side."""
    return df.groupBy(q(label).alias("label"), q(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support) per class seen in labels or predictions."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    # each cell counts once for its true class and once for its predicted class
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    totals = sides.groupBy("label").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("chosen").alias("chosen")
    )
    return totals.select(
        "label",
        _ratio(F.col("hits"), F.col("chosen")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("chosen")).alias("f1"),
        "support",
        "hits",
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted F1."""
    n = F.sum("support")
    return class_scores(df, label, prediction).agg(
        _ratio(F.sum("hits"), n).alias("accuracy"),
        _ratio(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"),
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) with accuracy, macro and weighted averages."""
    per_class = class_scores(df, label, prediction)
    measures = ["precision", "recall", "f1"]
    n = F.sum("support")
    summary = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), n).alias(f"weighted_{m}") for m in measures],
        _ratio(F.sum("hits"), n).alias("accuracy"),
        n.alias("support"),
    )

    def line(name: str, source: list[str]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[F.col(s).alias(m) for s, m in zip(source, measures)],
            F.col("support"),
        )

    averages = summary.select(
        F.inline(
            F.array(
                line("accuracy", ["accuracy"] * 3),
                line("macro avg", [f"macro_{m}" for m in measures]),
                line("weighted avg", [f"weighted_{m}" for m in measures]),
            )
        )
    )
    classes = per_class.select(q("label").cast("string").alias("class"), *measures, "support")
    return classes.unionByName(averages)


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: r2, mae, rmse."""
    y, e = q(label).cast("double"), q(label).cast("double") - q(prediction).cast("double")
    sums = df.agg(
        F.count("*").alias("n"), F.sum(e * e).alias("residual"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("spread")
    )
    total = F.col("spread") * F.col("n")
    return sums.select(
        F.when(total > 0, 1 - F.col("residual") / F.nullif(total, F.lit(0.0)))
        .when(F.col("residual") == 0, 1.0)
        .otherwise(0.0)
        .alias("r2"),
        "mae",
        F.sqrt(F.col("residual") / F.col("n")).alias("rmse"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """(rank, model, score) of the models that trained, best first, rounded to 4 places.

    `scores` is (model, score, status), one row per model, so the ranking window is tiny.
    """
    order = Window.orderBy(F.desc("score"), F.asc("model"))
    return (
        scores.where(F.col("status") == "ok")
        .select(F.row_number().over(order).cast("long").alias("rank"), "model", F.round("score", 4).alias("score"))
    )


def top_models(scores: DataFrame, n: int = 3) -> DataFrame:
    return leaderboard(scores).where(F.col("rank") <= n)


def stop_rules(scores: DataFrame) -> DataFrame:
    """One row: best score and whether training should go on."""
    best = scores.where(F.col("status") == "ok").agg(F.max("score").alias("best"))
    return best.select(
        "best",
        F.when(F.col("best").isNull(), "all_failed")
        .when(F.col("best") <= NO_SIGNAL, "no_signal")
        .when(F.col("best") >= LEAKAGE, "leakage")
        .otherwise("continue")
        .alias("verdict"),
    )


def accept_tuning(scores: DataFrame) -> DataFrame:
    """(model, baseline, tuned, improved, kept): tuned scores must win at four places."""
    improved = F.coalesce(F.round("tuned", 4) > F.round("baseline", 4), F.lit(False))
    return scores.select(
        "model",
        "baseline",
        "tuned",
        improved.alias("improved"),
        F.when(improved, F.col("tuned")).otherwise(F.col("baseline")).alias("kept"),
    )


def final_choice(scores: DataFrame) -> DataFrame:
    """The winning (stage, model, score); on ties the simpler stage stays."""
    stage_order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return scores.orderBy(F.desc("score"), stage_order, F.asc("model")).limit(1).select("stage", "model", "score")


def soft_vote(df: DataFrame, probabilities: list[str], out: str = "prediction") -> DataFrame:
    """Mean of the class probabilities of several models and its argmax (first on ties)."""
    mean = df.select("*", mean_vectors([q(c) for c in probabilities]).alias("_mean"))
    index = F.array_position("_mean", F.array_max("_mean")) - 1
    return mean.withColumn(out, index.cast("double")).withColumnRenamed("_mean", f"{out}_probability")


def mean_vectors(vectors: list[Column]) -> Column:
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(vectors))


def mean_vote(df: DataFrame, predictions: list[str], out: str = "prediction") -> DataFrame:
    total = q(predictions[0])
    for c in predictions[1:]:
        total = total + q(c)
    return df.withColumn(out, total / len(predictions))
