"""Rows of a file with one row group meet as many tasks as there are cores."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import forest, histograms
from tabloom.session import least_tasks, spread


def one_partition(spark, n):
    x = F.array((F.col("id") % 97).cast("double"), (F.col("id") % 41).cast("double"))
    rows = spark.range(0, n, 1, 1)
    return rows.select(F.col("id").alias("_row_id"), (F.col("id") % 97 + F.col("id") % 5).cast("double").alias("_label"), array_to_vector(x).alias("features"))


def test_spread_deals_rows_of_one_partition(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = one_partition(spark, 1_000)
    dealt = spread(rows, 1_000, 10)
    assert dealt.rdd.getNumPartitions() == least_tasks(spark, 1_000, 10) >= cores
    assert sorted(r["_row_id"] for r in dealt.collect()) == list(range(1_000))
    assert spread(rows, 1_000, 1_000).rdd.getNumPartitions() == 1


def test_boosting_passes_read_dealt_rows_and_no_old_trees(spark, monkeypatch):
    seen, cells = [], histograms.cells

    def watched(table, width, settings, pending, *rest):
        seen.append((table.rdd.getNumPartitions(), len(pending)))
        return cells(table, width, settings, pending, *rest)

    monkeypatch.setattr(histograms, "cells", watched)
    monkeypatch.setattr(histograms, "TASK_ROWS", 100)
    histograms.fit(one_partition(spark, 1_000), histograms.hist_settings("number", 1, rounds=3, depth=2))
    assert len(seen) == 6 and all(n >= spark.sparkContext.defaultParallelism and not old for n, old in seen)


def test_forest_deals_rows_of_one_file(spark, monkeypatch, tmp_path):
    seen, finished = [], forest.finished

    def watched(table, *rest):
        seen.append(table.rdd.getNumPartitions())
        return finished(table, *rest)

    monkeypatch.setattr(forest, "finished", watched)
    forest.fit(one_partition(spark, 60_000), forest.Growth(0, 1, depth=2), f"file://{tmp_path}/forest")
    assert seen and all(n >= min(6, spark.sparkContext.defaultParallelism) for n in seen)


@pytest.mark.parametrize("missing_left", [False, True])
def test_places_follow_every_split(missing_left):
    tree = histograms.Tree()
    for node, feature, cut in ((0, 0, 100), (1, 1, 7), (2, 0, 200)):
        tree.feature[node], tree.bin[node], tree.missing_left[node] = feature, cut, missing_left
        tree.left[node], tree.right[node] = tree.add(), tree.add()
    bins = np.random.default_rng(1).integers(0, 256, (500, 2)).astype(np.uint8)
    bins[:20, 0] = histograms.MISSING

    def walk(row):
        node = 0
        while tree.feature[node] >= 0:
            b = row[tree.feature[node]]
            goes = tree.missing_left[node] if b == histograms.MISSING else b <= tree.bin[node]
            node = tree.left[node] if goes else tree.right[node]
        return node

    assert tree.height() == 2
    assert tree.places(bins).tolist() == [walk(r) for r in bins]
