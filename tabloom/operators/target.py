"""Task detection, metric choice, label map, class weights and target log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import NUMERIC_TYPES, q
from ..functions.moments import adjusted_skew
from ..session import staged
from .profile import CLASS_LIMIT

CLASSIFICATION, REGRESSION = "classification", "regression"


#: Estimates of so many times the limit leave no doubt.
FAR = 5
#: Classes that models are trained for at most.
MAX_CLASSES = 10_000


def task_table(df: DataFrame, targets: list[str]) -> DataFrame:
    """(column, task) for each candidate target."""
    rows = [(c, detect_task(df, c)) for c in targets]
    return df.sparkSession.createDataFrame(rows, "column string, task string")


def detect_task(df: DataFrame, target: str) -> str:
    """Numeric targets with more than 20 distinct values are regression, all else classes.

    A sketch, combined inside tasks, settles what is far beyond the limit; only near it are values counted exactly,
    and then there are few of them.
    """
    if not isinstance(df.schema[target].dataType, NUMERIC_TYPES):
        return CLASSIFICATION
    if (df.agg(F.approx_count_distinct(q(target)).alias("n")).first()["n"] or 0) > FAR * CLASS_LIMIT:
        return REGRESSION
    return CLASSIFICATION if df.agg(F.count_distinct(q(target)).alias("n")).first()["n"] <= CLASS_LIMIT else REGRESSION


def class_metric(df: DataFrame, target: str) -> DataFrame:
    """One row: class balance, the metric it calls for, and whether to weight classes."""
    ratio = F.col("n_max") / F.col("n_min")
    return (
        df.where(q(target).isNotNull())
        .groupBy(q(target))
        .count()
        .agg(
            F.count("*").alias("n_classes"),
            F.max("count").cast("double").alias("n_max"),
            F.min("count").cast("double").alias("n_min"),
        )
        .select(
            "n_classes",
            F.round(ratio, 2).alias("imbalance_ratio"),
            F.when(ratio < 3, "accuracy").otherwise("f1_weighted").alias("primary_metric"),
            F.when(ratio < 3, "balanced").when(ratio <= 10, "moderate").otherwise("severe").alias("balance"),
            (ratio >= 3).alias("use_class_weight"),
        )
    )


def regression_metric(df: DataFrame, target: str) -> DataFrame:
    """One row: target skew and whether to log-transform."""
    skew = adjusted_skew(q(target).cast("double"))
    return df.agg(skew.alias("skew")).select(
        F.round("skew", 3).alias("target_skew"),
        F.coalesce(F.abs("skew") > 1, F.lit(False)).alias("log_transform_target"),
        F.lit("r2").alias("primary_metric"),
    )


def label_table(df: DataFrame, target: str) -> DataFrame:
    """(label, idx): sorted labels to 0..k-1, one row per class, however many there are.

    Labels are dealt by range; a label's index is its place in its range after the labels of the ranges before.
    """
    labels = df.where(q(target).isNotNull()).select(q(target).alias("label")).distinct()
    ranged = staged(labels.repartitionByRange("label").withColumn("_part", F.spark_partition_id()), "labels")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("label")) - 1
    return ranged.withColumn("_at", place).join(offsets, "_part").select("label", (F.col("_before") + F.col("_at")).cast("long").alias("idx"))


def label_list(df: DataFrame, target: str) -> list:
    """The labels in order. A target with more than MAX_CLASSES of them, such as free text, is refused."""
    table = label_table(df, target)
    found = table.limit(MAX_CLASSES + 1).count()
    if found > MAX_CLASSES:
        raise ValueError(f"target {target!r} has more than {MAX_CLASSES} different values: it is no class to be learnt")
    return [r["label"] for r in table.orderBy("idx").collect()]


def label_index(labels: list, target: Column, dtype: T.DataType) -> Column:
    """Class index of a target value, as the double MLlib wants."""
    pairs = [x for i, v in enumerate(labels) for x in (F.lit(v).cast(dtype), F.lit(float(i)))]
    return F.create_map(*pairs)[target]


def label_of(labels: list, prediction: Column, dtype: T.DataType) -> Column:
    """The inverse: original label of a predicted class index."""
    values = F.array(*[F.lit(v).cast(dtype) for v in labels])
    return F.element_at(values, prediction.cast("int") + 1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight n / (k * n_c)."""
    counts = df.groupBy(q(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    # one row joined to one row per class
    return counts.join(F.broadcast(totals)).select(
        "label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    rows = class_weights(df, label).collect()
    pairs = [x for r in rows for x in (F.lit(r["label"]), F.lit(float(r["weight"])))]
    return df.withColumn(out, F.create_map(*pairs)[q(label)])


def log_target(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def unlog_target(value: Column) -> Column:
    return F.expm1(value)


def should_log_target(train: DataFrame, target: str, skewed: bool) -> bool:
    """Skewed regression targets without negative training values."""
    if not skewed:
        return False
    low = train.agg(F.min(q(target))).first()[0]
    return low is not None and not math.isnan(low) and low >= 0
