"""One table of sufficient statistics per phase for all category columns.

The training rows are unpivoted and counted once, per (column, value) and, where the target is a class, per label. Chi-square
and ANOVA tests, shares, rare values and target encodings are sums over that table's cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import long_form, q
from ..functions.moments import sum_of_squares

RARE_LIMIT = 0.01
OTHER = "Other"


@dataclass
class CategoryStats:
    """Cells (column, value, label, n, ny, mean, ss, log_mean, log_ss): rows, rows with a target, its mean and sum of squared
    deviations, and the same of the logged target. `label` is null unless the target is a class."""

    cells: DataFrame

    @staticmethod
    def of(df: DataFrame, columns: list[str], target: str | None = None, classes: bool = False, logged: Column | None = None) -> "CategoryStats":
        """One scan, one unpivot and one map-side combined shuffle."""
        y = F.lit(None).cast("double") if target is None or classes else q(target).cast("double")
        log = F.lit(None).cast("double") if logged is None else logged
        label = q(target) if classes else F.lit(None).cast("double")
        rows = df.select(label.alias("_label"), y.alias("_y"), log.alias("_log"), *[q(c) for c in columns])
        cells = long_form(rows, columns, ["_label", "_y", "_log"]).groupBy("column", "value", F.col("_label").alias("label")).agg(
            F.count("*").alias("n"), F.count("_y").alias("ny"), F.avg("_y").alias("mean"), sum_of_squares(F.col("_y")).alias("ss"),
            F.avg("_log").alias("log_mean"), sum_of_squares(F.col("_log")).alias("log_ss"),
        )
        return CategoryStats(cells)

    def only(self, columns: list[str]) -> "CategoryStats":
        return CategoryStats(self.cells.where(F.col("column").isin(columns)))

    def crosstab(self) -> DataFrame:
        """(column, value, label, n): contingency tables of all columns."""
        return self.cells.select("column", "value", "label", "n")

    def values(self) -> DataFrame:
        """(column, value, n, ny, mean, ss, log_mean, log_ss) over all labels; a class label counts as a number."""
        label = F.col("label").cast("double")
        if self.cells.schema["label"].dataType.typeName() == "string":
            label = F.lit(None).cast("double")
        ny = F.coalesce(F.when(F.col("ny") > 0, F.col("ny")), F.when(label.isNotNull(), F.col("n")), F.lit(0))
        cells = self.cells.withColumn("ny", ny).withColumn("mean", F.coalesce("mean", label))
        return merged(cells, ["column", "value"])

    def shares(self) -> DataFrame:
        """(column, value, n, share) of every category."""
        counts = self.cells.groupBy("column", "value").agg(F.sum("n").alias("n"))
        totals = counts.groupBy("column").agg(F.sum("n").alias("total"))  # one row per column
        return counts.join(totals, "column").select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"))

    def rare(self) -> DataFrame:
        """(column, value) of categories below 1% of the rows."""
        return self.shares().where(F.col("share") < RARE_LIMIT).select("column", "value")

    def folded(self) -> DataFrame:
        """The columns of `values` with the rare categories of each column made one."""
        known = self.values()
        totals = known.groupBy("column").agg(F.sum("n").alias("total"))
        name = F.when(F.col("n") / F.col("total") < RARE_LIMIT, F.lit(OTHER)).otherwise(F.col("value"))
        return merged(known.join(totals, "column").withColumn("value", name), ["column", "value"])

    def chi2(self) -> DataFrame:
        """(column, statistic, dof, n_values, n_classes) of category x class independence.

        Cells never seen add their expected count. 2x2 tables get the continuity correction: all four
        differences are equal there, so it needs only the sum of 1/expected.
        """
        by_class = self.cells.groupBy("column", "label").agg(F.sum("n").alias("class_n"))
        totals = by_class.groupBy("column").agg(F.sum("class_n").alias("total"), F.count("*").alias("n_classes"))
        by_value = self.cells.groupBy("column", "value").agg(F.sum("n").cast("double").alias("row_n"), F.count("*").alias("seen_classes"))
        expected = F.col("row_n") * F.col("class_n") / F.col("total")
        gap = F.abs(F.col("n") - expected)
        one = F.col("seen_classes")  # so many cells of a value share its row
        sums = (
            self.crosstab()
            .join(by_value, ["column", "value"])
            .join(by_class, (self.cells["column"] == by_class["column"]) & self.cells["label"].eqNullSafe(by_class["label"]))
            .drop(by_class["column"], by_class["label"])
            .join(totals, "column")
            .groupBy("column")
            .agg(
                F.sum(gap * gap / expected).alias("seen"),
                F.sum(expected).alias("expected_seen"),
                F.max(gap).alias("gap"),
                F.sum(1 / F.col("row_n") / one).alias("inverse_rows"),
                F.sum(F.col("n") / F.col("class_n") / F.col("class_n")).alias("inverse_classes"),
                F.rint(F.sum(1 / one)).cast("long").alias("n_values"),
                F.first("n_classes").alias("n_classes"),
                F.first("total").alias("total"),
            )
        )
        plain = F.col("seen") + F.col("total") - F.col("expected_seen")
        corrected = F.pow(F.greatest(F.col("gap") - 0.5, F.lit(0.0)), 2) * F.col("total") * F.col("inverse_rows") * F.col("inverse_classes")
        dof = (F.col("n_values") - 1) * (F.col("n_classes") - 1)
        statistic = F.when(dof < 1, None).when(dof == 1, corrected).otherwise(plain)
        return sums.select("column", statistic.alias("statistic"), dof.alias("dof"), "n_values", "n_classes")

    def anova(self) -> DataFrame:
        """(column, statistic, df1, df2) of the one-way F test of the target over categories."""
        known = self.values().where("ny > 0")
        grand = known.groupBy("column").agg((F.sum(F.col("ny") * F.col("mean")) / F.sum("ny")).alias("grand"))
        sums = known.join(grand, "column").groupBy("column").agg(
            F.sum(F.col("ny") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
            F.sum("ss").alias("within"),
            (F.count("*") - 1).alias("df1"),
            (F.sum("ny") - F.count("*")).alias("df2"),
        )
        ratio = (F.col("between") / F.col("df1")) / F.nullif(F.col("within") / F.col("df2"), F.lit(0.0))
        usable = (F.col("df1") > 0) & (F.col("df2") > 0)
        return sums.select("column", F.when(usable, ratio).alias("statistic"), "df1", "df2")

    def encodings(self, logged: bool = False, fold: bool = False) -> DataFrame:
        """(column, value, encoding, grand) with variance-based smoothing towards the global mean.

        weight = V*n / (V*n + ss/n), V the population variance of the target; the global mean is used
        where the weight is undefined. With `fold` rare values are encoded as one.
        """
        mean, ss = ("log_mean", "log_ss") if logged else ("mean", "ss")
        known = (self.folded() if fold else self.values()).select("column", "value", F.col("ny").alias("n"), F.col(mean).alias("mean"), F.col(ss).alias("ss"))
        grand = known.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
        known = known.join(grand, "column")
        spread = known.groupBy("column").agg(((F.sum("ss") + F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2))) / F.sum("n")).alias("v"))
        pull = F.col("v") * F.col("n")
        weight = pull / F.nullif(pull + F.col("ss") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
        encoding = F.coalesce(weight * F.col("mean") + (1 - weight) * F.col("grand"), F.col("grand"))
        return known.join(spread, "column").select("column", "value", encoding.alias("encoding"), "grand")


def merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells made one per key. Means are taken from their column's mean before they are squared, so nothing large cancels."""
    weight = F.col("ny").cast("double")
    centre = cells.groupBy("column").agg(
        (F.sum(weight * F.col("mean")) / F.nullif(F.sum("ny"), F.lit(0))).alias("_c"), (F.sum(weight * F.col("log_mean")) / F.nullif(F.sum("ny"), F.lit(0))).alias("_d")
    )
    parts = cells.join(centre, "column").withColumns({"_m": F.col("mean") - F.col("_c"), "_l": F.col("log_mean") - F.col("_d")})
    sums = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("ny").alias("ny"), F.first("_c").alias("_c"), F.first("_d").alias("_d"), F.sum("ss").alias("ss"), F.sum("log_ss").alias("log_ss"),
        *[F.sum(weight * F.col(v)).alias(f"{v}1") for v in ("_m", "_l")], *[F.sum(weight * F.col(v) * F.col(v)).alias(f"{v}2") for v in ("_m", "_l")],
    )
    ny = F.nullif(F.col("ny").cast("double"), F.lit(0.0))

    def about(v: str) -> Column:
        return F.coalesce(F.greatest(F.col(f"{v}2") - F.col(f"{v}1") * F.col(f"{v}1") / ny, F.lit(0.0)), F.lit(0.0))

    return sums.select(
        *keys, "n", "ny", (F.col("_c") + F.col("_m1") / ny).alias("mean"), (F.col("ss") + about("_m")).alias("ss"),
        (F.col("_d") + F.col("_l1") / ny).alias("log_mean"), (F.col("log_ss") + about("_l")).alias("log_ss"),
    )
