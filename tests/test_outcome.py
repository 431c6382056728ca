"""A whole run: its log, report and tuning table, and the folder it is kept in."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import learners as ln, target
from tabloom.operators.categories import CategoryStats
from tabloom.plans import run as runs
from tabloom.plans.prepare import Preparer
from tabloom.session import new_path, remove
from tabloom.streaming.scoring import read_table_stream, score_stream_batches


@pytest.fixture(scope="module")
def outcome(orders):
    df = orders.drop("y_cls", "y_imb", "y_reg")
    preparer = Preparer("y_bin", key_cols=["o_orderkey"], leakage_cols=["price_twin"], trees=5)
    return runs.run(df, preparer, ["logistic_regression", "decision_tree"], folds=2, points=2, tune_top=1)


def test_log_names_every_decision(outcome):
    rows = outcome.log().orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    train = [(r["phase"], r["action"], r["column"]) for r in rows]
    assert ("train", "baseline", "logistic_regression") in train and ("train", "verdict", None) in train
    assert train[-1][0] == "choice" and train[-1][1:] == (outcome.winner.stage, outcome.winner.model)
    assert {r[1] for r in train if r[0] == "tune"} <= {"kept", "rejected"} and any(r[0] == "ensemble" for r in train)


def test_report_and_tuning(outcome):
    report = {r["class"]: r for r in outcome.report().collect()}
    assert report["accuracy"]["f1"] == pytest.approx(outcome.winner.metrics["accuracy"])
    (row,) = outcome.tuning().collect()
    assert row["kept"] == (round(row["tuned"], 4) > round(row["baseline"], 4)) and row["params"].startswith("{")


def test_saved_and_read_back(spark, outcome, orders):
    path = new_path(spark, "outcome")
    outcome.save(path)
    bundle = runs.load_outcome(spark, path)
    key = lambda df: sorted((r["o_orderkey"], r["y_bin"]) for r in df.collect())
    assert key(bundle.predict(orders, ["o_orderkey"])) == key(outcome.predict(orders, ["o_orderkey"]))
    assert bundle.facts["model"] == outcome.winner.model
    assert spark.read.parquet(f"{path}/log").count() == outcome.log().count()


def test_half_written_and_foreign_folders_are_refused(spark, outcome, monkeypatch):
    path = new_path(spark, "outcome")
    outcome.save(path)
    monkeypatch.setattr(runs, "BUNDLE_VERSION", 2)
    with pytest.raises(ValueError, match="version"):
        runs.load_outcome(spark, path)
    monkeypatch.undo()
    remove(spark, f"{path}/manifest")
    with pytest.raises(ValueError, match="no whole outcome"):
        runs.load_outcome(spark, path)


def test_streams_with_neighbours_and_lookups_equal_the_batch(spark, orders):
    raw = orders.select("o_orderkey", "price", "spiky", "code", "y_bin").withColumn("code", F.concat("code", F.lit("-"), F.col("o_orderkey").cast("string").substr(-2, 2)))
    prepared = Preparer("y_bin", key_cols=["o_orderkey"], trees=3, top_n=99).fit(raw)
    fitted = ln.fit_learner("knn", prepared.train, ln.Job("classification", 2))
    fitted.broadcast_bytes = 0  # searched by joins
    source, sink, log = (new_path(spark, n) for n in ("source", "sink", "log"))
    raw.repartition(3).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        score_stream_batches(read_table_stream(spark, source, raw.schema), prepared.model, fitted, sink, log, ["o_orderkey"]).awaitTermination()
    key = lambda df: sorted((r["o_orderkey"], r["y_bin"], tuple(r["probability"])) for r in df.collect())
    assert key(spark.read.parquet(sink)) == key(prepared.model.score(fitted, raw, ["o_orderkey"]))


def test_categories_are_counted_once(orders, monkeypatch):
    calls, of = [], CategoryStats.of
    monkeypatch.setattr(CategoryStats, "of", staticmethod(lambda *a, **k: calls.append(a[1]) or of(*a, **k)))
    Preparer("y_bin", key_cols=["o_orderkey"], leakage_cols=["price_twin"], trees=2).fit(orders.drop("y_cls", "y_imb", "y_reg"))
    assert len(calls) == 1
    plan = of(orders, ["code", "prio", "shop_txt"], "y_bin", classes=True).cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate") == 1


def test_merged_cells_equal_direct_sums(orders):
    stats = CategoryStats.of(orders, ["prio", "shop_txt"], "y_reg")
    direct = orders.groupBy("prio").agg(F.count("*").alias("n"), F.avg("y_reg").alias("m"), (F.var_pop("y_reg") * F.count("*")).alias("ss")).collect()
    got = {r["value"]: r for r in stats.values().where("column = 'prio'").collect()}
    for r in direct:
        assert got[r["prio"]]["n"] == r["n"] and got[r["prio"]]["mean"] == pytest.approx(r["m"]) and got[r["prio"]]["ss"] == pytest.approx(r["ss"])
    folded = stats.folded().where("column = 'prio'").collect()
    rare = {r["value"] for r in stats.rare().where("column = 'prio'").collect()}
    assert {r["value"] for r in folded} == ({r["prio"] for r in direct} - rare) | ({"Other"} if rare else set())
    other = orders.where(F.col("prio").isin(list(rare))).agg(F.avg("y_reg"), F.var_pop("y_reg") * F.count("*")).first()
    (row,) = [r for r in folded if r["value"] == "Other"]
    assert row["mean"] == pytest.approx(other[0]) and row["ss"] == pytest.approx(other[1])


def test_labels_are_indexed_without_a_collect(spark, monkeypatch):
    many = spark.range(30_000).select(F.concat(F.lit("label "), F.md5(F.col("id").cast("string"))).alias("y")).repartition(7)
    got = target.label_table(many, "y").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(30_000)) and [r["label"] for r in got] == sorted(r["label"] for r in got)
    with pytest.raises(ValueError, match="no class"):
        target.label_list(many, "y")
    assert target.label_list(spark.createDataFrame([("b",), ("a",), (None,)], "y string"), "y") == ["a", "b"]


@pytest.mark.parametrize("values,task", [(20, "classification"), (21, "regression"), (5000, "regression")])
def test_task_by_the_number_of_values(spark, values, task):
    assert target.detect_task(spark.range(6000).select((F.col("id") % values).alias("y")), "y") == task
