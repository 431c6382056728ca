"""Statistical feature selection: correlation, ANOVA and chi-square."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import q
from ..functions.pvalues import chi2_p_value, f_p_value
from .categories import CategoryStats

CORRELATION_LIMIT = 0.80
P_LIMIT = 0.05


def correlations(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Pearson matrix in one pass; columns without variance correlate 0 with everything."""
    vectors = df.select(array_to_vector(F.array(*[q(c).cast("double") for c in columns])).alias("v"))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    return [
        [1.0 if i == j else 0.0 if math.isnan(r) else float(r) for j, r in enumerate(row)]
        for i, row in enumerate(matrix)
    ]


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_i, col_j, abs_r) for every pair i < j."""
    r = correlations(df, columns)
    rows = [
        (columns[i], columns[j], abs(r[i][j]))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, "col_i string, col_j string, abs_r double")


def target_correlation_table(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, abs_r) against a numeric target or class index."""
    r = correlations(df, [*columns, target])[-1]
    rows = [(c, abs(r[i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, abs_r double")


def multicollinear(columns: list[str], r: list[list[float]], with_target: list[float]) -> list[str]:
    """Of each pair above the limit drop the one further from the target; ties drop the later."""
    dropped = set()
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            if abs(r[i][j]) > CORRELATION_LIMIT:
                weaker = i if abs(with_target[i]) < abs(with_target[j]) else j
                dropped.add(columns[weaker])
    return sorted(dropped)


def multicollinear_columns(df: DataFrame, columns: list[str], target: str) -> list[str]:
    """Feature and target correlations come out of the same pass."""
    if len(columns) < 2:
        return []
    r = correlations(df, [*columns, target])
    return multicollinear(columns, r, r[-1])


def category_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, share) of every category."""
    return CategoryStats.of(df, columns).shares()


def crosstab(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, value, label, n): contingency tables of all columns in one shuffle."""
    return CategoryStats.of(df, columns, label, classes=True).crosstab()


def chi2_table(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, statistic, dof, n_values, n_classes) of category x class independence."""
    return CategoryStats.of(df, columns, label, classes=True).chi2()


def anova_table(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, statistic, df1, df2) of the one-way F test of the target over categories."""
    return CategoryStats.of(df, columns, target).anova()


def weak_categories(stats: CategoryStats, columns: list[str], regression: bool) -> list[str]:
    """Categories whose test does not reach significance; undecidable ones stay."""
    if not columns:
        return []
    if regression:
        p = {r["column"]: f_p_value(r["statistic"], r["df1"], r["df2"]) for r in stats.anova().collect()}
    else:
        p = {r["column"]: chi2_p_value(r["statistic"], r["dof"]) for r in stats.chi2().collect()}
    return [c for c in columns if p.get(c) is not None and p[c] > P_LIMIT]
