"""Every query with a SQL counterpart gives the same rows on both engines."""

import math

import pandas as pd
import pytest

import __spark_entry__ as entry
from tabloom.catalog.registry import load_all

CHECKS = load_all()
#: Fits of a hundred rounds and more, minutes in all; test_models and test_trees try the same learners on fewer.
LONG = {n for n in CHECKS if n.endswith(("_adaboost", "_gradient_boosting", "_gbt_hist"))} | {"baseline_models", "baseline_regressors", "stacking_classifier"}


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return v.item() if hasattr(v, "item") else v

    cells = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in cells.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql and n not in LONG])
def test_equals_sql(name, spark, duck, sf_dir):
    ours = CHECKS[name].query(spark, sf_dir).toPandas()
    theirs = duck.execute(CHECKS[name].sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert rows(ours) == rows(theirs)


def test_entry_and_contract(spark):
    assert set(entry.oracle_sql()) < set(entry.queries())
    report = {r["class"]: r for r in entry.entry(spark).collect()}
    assert report["accuracy"]["f1"] > 0.85
