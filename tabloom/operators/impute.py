"""Filling of missing values from training statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import of_kind, per_column, q, replace_columns
from ..functions.moments import adjusted_skew
from ..functions.quantiles import quantiles

SKEW_LIMIT = 1.0
NONE = "None"


def as_category(df: DataFrame, column: str) -> Column:
    """Text of a category, with booleans spelled as in the training labels and nulls named."""
    if df.schema[column].dataType.typeName() == "boolean":
        text = F.when(q(column), "True").when(~q(column), "False")
    else:
        text = q(column).cast("string")
    return F.coalesce(text, F.lit(NONE))


@dataclass
class Imputer:
    categories: list[str] = field(default_factory=list)
    fills: dict[str, float] = field(default_factory=dict)
    methods: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Absent columns are added: text as 'None', numbers as their fill value."""
        new: dict[str, Column] = {
            c: as_category(df, c) if c in df.columns else F.lit(NONE) for c in self.categories
        }
        for c, fill in self.fills.items():
            value = q(c).cast("double") if c in df.columns else F.lit(None).cast("double")
            new[c] = F.coalesce(value, F.lit(fill))
        return replace_columns(df, new)


def numeric_fill_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, skew, mean): what the choice of fill value rests on."""
    return per_column(
        df,
        columns,
        {
            "n": lambda c: F.count(q(c)),
            "skew": lambda c: adjusted_skew(q(c).cast("double")),
            "mean": lambda c: F.avg(q(c).cast("double")),
        },
    )


def skew_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return numeric_fill_table(df, columns).select("column", "n", "skew")


def fit_imputer(
    train: DataFrame, skip: list[str], approx: bool = False, rows: int | None = None
) -> Imputer:
    """Mean for symmetric columns, median for skewed ones, 0 where nothing was ever seen."""
    numbers = of_kind(train, "numeric", skip=skip)
    state = Imputer(categories=of_kind(train, "text", "boolean", skip=skip))
    if not numbers:
        return state
    facts = {r["column"]: r for r in numeric_fill_table(train, numbers).collect()}
    skewed = [c for c, r in facts.items() if r["n"] and (r["skew"] is None or abs(r["skew"]) > SKEW_LIMIT)]
    medians = quantiles(train, skewed, [0.5], approx=approx, rows=rows)
    for c in numbers:
        if not facts[c]["n"]:
            state.fills[c], state.methods[c] = 0.0, "zero"
        elif c in medians:
            state.fills[c], state.methods[c] = float(medians[c][0]), "median"
        else:
            state.fills[c], state.methods[c] = float(facts[c]["mean"]), "mean"
    return state
