import pytest
from pyspark.sql import functions as F

from tabloom.catalog.models import frames
from tabloom.operators import boosting, learners as ln, search
from tabloom.plans.prepare import Preparer
from tabloom.plans.run import run
from tabloom.session import new_path

FAST = {
    "adaboost": {"n_estimators": 8},
    "gradient_boosting": {"n_estimators": 15},  # a rate of 0.1 counts from the first tree on
    "gbt_hist": {"n_estimators": 3},
    "random_forest": {"n_estimators": 10},
    "decision_tree": {"max_depth": 6},
}


@pytest.fixture(scope="module")
def binary(spark, sf_dir):
    data = frames(spark, sf_dir, "y_bin")
    data.train, data.test = data.train.persist(), data.test.persist()
    return data


@pytest.fixture(scope="module")
def numbers(spark, sf_dir):
    data = frames(spark, sf_dir, "y_reg")
    data.train, data.test = data.train.persist(), data.test.persist()
    return data


def outputs(df):
    return {r["_row_id"]: (r["prediction"], r["probability"] if "probability" in df.columns else None) for r in df.collect()}


@pytest.mark.parametrize("name", ln.CLASS_MODELS)
def test_classifiers_learn_and_round_trip(spark, binary, name):
    fitted = ln.fit_learner(name, binary.train, binary.job(calibration_folds=2), FAST.get(name))
    scored = fitted.transform(binary.test)
    assert search.measure(scored, "classification")["accuracy"] > 0.8
    first = outputs(scored)
    assert all(abs(sum(p) - 1) < 1e-9 and len(p) == 2 for _, p in first.values())
    path = new_path(spark, "model")
    fitted.save(path)
    assert outputs(ln.load_model(spark, path).transform(binary.test)) == first


@pytest.mark.parametrize("name", ln.NUMBER_MODELS)
def test_regressors_learn_and_round_trip(spark, numbers, name):
    fitted = ln.fit_learner(name, numbers.train, numbers.job(), FAST.get(name))
    scored = fitted.transform(numbers.test)
    assert search.measure(scored, "regression")["r2"] > 0.6
    path = new_path(spark, "model")
    fitted.save(path)
    assert outputs(ln.load_model(spark, path).transform(numbers.test)) == outputs(scored)


@pytest.mark.parametrize("name", ["linear_svc", "gradient_boosting", "adaboost", "logistic_regression"])
def test_three_classes(spark, sf_dir, name):
    data = frames(spark, sf_dir, "y_reg")
    third = F.when(F.col("_label") < 180, 0.0).when(F.col("_label") < 350, 1.0).otherwise(2.0)
    data.train, data.test = data.train.withColumn("_label", third).persist(), data.test.withColumn("_label", third)
    data.n_classes = 3
    fitted = ln.fit_learner(name, data.train, data.job(calibration_folds=2), FAST.get(name))
    scored = fitted.transform(data.test)
    assert search.measure(scored, "classification")["accuracy"] > 0.5
    assert all(len(p) == 3 and abs(sum(p) - 1) < 1e-9 for _, p in outputs(scored).values())
    path = new_path(spark, "model")
    fitted.save(path)
    assert outputs(ln.load_model(spark, path).transform(data.test)) == outputs(scored)


def test_knn_by_cells_equals_broadcast(binary):
    for weights in ("uniform", "distance"):
        fitted = ln.fit_learner("knn", binary.train, binary.job(), {"n_neighbors": 3, "weights": weights})
        small = outputs(fitted.transform(binary.test))
        fitted.broadcast_bytes = 0
        large = outputs(fitted.transform(binary.test))
        assert small.keys() == large.keys()
        for k in small:
            assert small[k][1] == pytest.approx(large[k][1], abs=1e-9)


def test_weighted_median(spark):
    trees = [(1.0, {"value": 10.0}), (1.0, {"value": 30.0}), (2.5, {"value": 20.0})]
    got = spark.range(1).select(boosting.weighted_median(trees, F.array(F.lit(0.0)))).first()[0]
    assert got == 20.0


def test_class_weights_change_the_fit(binary):
    weighted = binary.train.withColumn("_weight", F.when(F.col("_label") == 1, 50.0).otherwise(1.0))
    plain = ln.fit_learner("logistic_regression", binary.train, binary.job())
    tilted = ln.fit_learner("logistic_regression", weighted, binary.job(weighted=True))
    ones = lambda m: m.transform(binary.test).where("prediction = 1").count()
    assert ones(tilted) > ones(plain)


def test_ensembles_and_failures(spark, binary, numbers):
    results = search.run_baselines(
        binary.train, binary.test, binary.job(), "accuracy", ["logistic_regression", "decision_tree", "no_such_model"]
    )
    assert [r.status == "ok" for r in results] == [True, True, False]
    members = search.rank(results)
    assert len(members) == 2
    both = search.run_ensembles(members, binary.train, binary.test, binary.job(), "accuracy")
    assert all(r.status == "ok" and r.score > 0.85 for r in both)
    path = new_path(spark, "stack")
    both[1].fitted.save(path)
    assert outputs(ln.load_model(spark, path).transform(binary.test)) == outputs(both[1].fitted.transform(binary.test))
    reg = search.rank(search.run_baselines(numbers.train, numbers.test, numbers.job(), "r2", ["ridge", "linear_regression"]))
    for r in search.run_ensembles(reg, numbers.train, numbers.test, numbers.job(), "r2"):
        assert r.status == "ok" and r.score > 0.7
    with pytest.raises(RuntimeError):
        search.run_baselines(binary.train, binary.test, binary.job(), "accuracy", ["no_such_model"])


def test_grid_points():
    grid = ln.GRIDS["gradient_boosting"]
    points = search.grid_points(grid)
    assert len(points) == 10 and len({str(p) for p in points}) == 10 and points == search.grid_points(grid)
    assert len(search.grid_points(ln.GRIDS["ridge"])) == 5 and search.grid_points({}) == []


def test_tuning_must_win_at_four_places():
    base = search.Result("m", "baseline", score=0.90001)
    assert search.tuned_or_baseline(base, search.Result("m", "tuned", score=0.90004)) is base
    better = search.Result("m", "tuned", score=0.9002)
    assert search.tuned_or_baseline(base, better) is better
    assert search.tuned_or_baseline(base, search.Result("m", "tuned", status="failed")) is base


def test_run_ends_early_without_signal(orders):
    noise = orders.select("o_orderkey", "shop", "skewed", F.col("price_twin").alias("y"))
    outcome = run(noise, Preparer("y", key_cols=["o_orderkey"], trees=5), ["linear_regression", "decision_tree"])
    assert outcome.verdict == "no_signal" and outcome.winner is None


def test_run_picks_and_scores(orders):
    df = orders.drop("y_cls", "y_imb", "y_reg")
    preparer = Preparer("y_bin", key_cols=["o_orderkey"], leakage_cols=["price_twin"], trees=5)
    outcome = run(df, preparer, ["logistic_regression", "decision_tree"], folds=2, points=1, tune_top=1)
    assert outcome.verdict == "continue" and outcome.choice["score"] > 0.85
    got = outcome.predict(df.drop("y_bin"), ["o_orderkey"])
    assert got.count() == df.count() and {r[0] for r in got.select("y_bin").distinct().collect()} == {"big", "small"}
