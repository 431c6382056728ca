import json

import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile as pf, rows
from tabloom.operators.learners import Job, fit_learner
from tabloom.operators.split import is_test
from tabloom.plans.prepare import Preparer, PreparedModel
from tabloom.session import new_path
from tabloom.sources.tables import nan_to_null, validate_input
from tabloom.streaming.scoring import read_table_stream, score_stream

OTHERS = {"y_reg": ["y_cls", "y_imb", "y_bin"], "y_bin": ["y_cls", "y_imb", "y_reg"], "y_imb": ["y_cls", "y_reg", "y_bin"]}


def prepare(orders, target, **options):
    settings = dict(key_cols=["o_orderkey"], leakage_cols=["price_twin"], trees=5, tree_depth=5)
    return Preparer(target, **{**settings, **options}).fit(orders.drop(*OTHERS[target]))


@pytest.fixture(scope="module")
def regression(orders):
    return prepare(orders, "y_reg", top_n=50)


@pytest.fixture(scope="module")
def linear(regression):
    return fit_learner("linear_regression", regression.train, Job("regression"))


def facts(prepared):
    """State without the paths of written lookup tables and all-row trim figures."""
    d = json.loads(prepared.state.to_json())
    d["outliers"].pop("rare_lookup")
    d.pop("trim")
    return d


def test_state_depends_on_training_rows_only(orders, regression):
    test_row = is_test(F.col("o_orderkey"), 0.2, 42)
    changed = orders.withColumn("price", F.when(test_row, F.col("price") * 50).otherwise(F.col("price")))
    changed = changed.withColumn("shop_txt", F.when(test_row, "new").otherwise(F.col("shop_txt")))
    assert facts(prepare(changed, "y_reg", top_n=50)) == facts(regression)


def test_result_does_not_depend_on_partitions(orders, regression):
    again = prepare(orders.repartition(11), "y_reg", top_n=50)
    for phase in ("text", "imputer", "outliers", "encoder", "scaler"):
        a, b = json.dumps(facts(regression)[phase]), json.dumps(facts(again)[phase])
        assert json.loads(a, parse_float=lambda x: round(float(x), 6)) == json.loads(b, parse_float=lambda x: round(float(x), 6))


def test_phases_found_what_was_planted(regression):
    s = regression.state
    assert s.trim.high_missing == ["mostly_null"] and s.trim.near_constant == ["near_const"]
    assert s.trim.id_like[:2] == ["o_orderkey", "row_num"] and s.trim.leakage == ["price_twin"]
    assert s.text.date_formats == {"odate": "yyyy-M-d"}
    assert s.text.splits == {"code": ("/", 3), "prio": ("-", 2)}
    assert s.imputer.methods["price"] == "mean" and s.imputer.methods["skewed"] == "median"
    assert "skewed" in s.outliers.logged and "odate_Year" in s.imputer.fills


def test_features_have_no_nulls(orders, regression):
    out = regression.model.features(orders, ["o_orderkey"])
    assert out.columns == ["o_orderkey", *regression.state.features]
    nulls = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in out.columns]).first()
    assert sum(nulls) == 0 and out.count() == orders.count()


def test_training_vectors_equal_scoring_features(orders, regression):
    s = regression.state
    named = {r["_row_id"]: r for r in regression.cleaned().collect()}
    raw = regression.model.features(orders, ["o_orderkey"]).collect()
    assert len(named) == len(raw)
    for r in raw[::50]:
        both = [(named[str(r["o_orderkey"])][c], r[c]) for c in s.features]
        assert all(abs(a - b) < 1e-9 for a, b in both)


def scores(df, target):
    return {r["o_orderkey"]: r[target] for r in df.collect()}


def test_scoring_is_row_wise_and_survives_saving(spark, orders, regression, linear):
    whole = scores(regression.model.score(linear, orders, ["o_orderkey"]), "y_reg")
    part = scores(regression.model.score(linear, orders.where("o_orderkey % 3 = 0"), ["o_orderkey"]), "y_reg")
    assert part == {k: v for k, v in whole.items() if k % 3 == 0}
    path = new_path(spark, "state")
    regression.model.save(path)
    restored = PreparedModel.load(spark, path)
    assert scores(restored.score(linear, orders, ["o_orderkey"]), "y_reg") == whole


def test_unseen_shapes_of_data(orders, regression, linear):
    odd = orders.drop("skewed", "shop_txt").withColumn("extra", F.lit(1)).withColumn("prio", F.lit("9-NEW"))
    got = scores(regression.model.score(linear, odd, ["o_orderkey"]), "y_reg")
    assert len(got) == orders.count() and all(v is not None for v in got.values())


def test_stream_equals_batch(spark, orders, regression, linear):
    raw = orders.drop("y_reg")
    source, sink, log = (new_path(spark, n) for n in ("src", "sink", "log"))
    raw.repartition(3).write.parquet(source)
    stream = read_table_stream(spark, source, raw.schema)
    score_stream(stream, regression.model, linear, sink, log, ["o_orderkey"]).awaitTermination()
    assert scores(spark.read.parquet(sink), "y_reg") == scores(regression.model.score(linear, raw, ["o_orderkey"]), "y_reg")


def test_labels_come_back_and_severe_imbalance_is_balanced(orders):
    p = prepare(orders, "y_imb")
    counts = {r["_label"]: r["count"] for r in p.train.groupBy("_label").count().collect()}
    assert len(set(counts.values())) == 1 and p.state.balanced > 0
    assert p.train.select("_row_id").distinct().count() == p.train.count()
    model = fit_learner("decision_tree", p.train, Job("classification", 2), {"max_depth": 4})
    out = p.model.score(model, orders, ["o_orderkey"])
    assert {r["y_imb"] for r in out.select("y_imb").distinct().collect()} <= {0, 1}


def test_sampling_before_the_split(orders):
    p = prepare(orders, "y_bin", max_rows=400)
    assert 395 <= p.train.count() + p.test.count() <= 405


def test_rare_values_beyond_the_inline_list_use_a_lookup(spark, orders, monkeypatch):
    from tabloom.operators import outliers

    df = orders.withColumn("tag", F.when(F.col("o_orderkey") % 5 < 3, "common").otherwise(F.concat(F.lit("t"), F.col("o_orderkey"))))
    df = df.withColumn("tag", F.when(F.col("y_reg") > 250, F.concat("tag", F.lit("x"))).otherwise(F.col("tag")))
    inline, none = outliers.rare_values(df, ["tag"])
    nothing, lookup = outliers.rare_values(df, ["tag"], inline=10)
    assert list(inline) == ["tag"] and not none and list(lookup) == ["tag"] and not nothing
    a = outliers.Outliers(rare=inline).transform(df).select("o_orderkey", "tag")
    b = outliers.Outliers(rare_lookup=lookup).transform(df).select("o_orderkey", "tag")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_guards(spark, orders):
    with pytest.raises(TypeError, match="tags"):
        Preparer("y_reg").fit(orders.withColumn("tags", F.array(F.lit(1))))
    with pytest.raises(ValueError, match="not found"):
        validate_input(orders, "nope")
    with pytest.raises(ValueError, match="all_null"):
        validate_input(orders.withColumn("y", F.lit(None).cast("double")), "y")
    with pytest.raises(ValueError, match="too_few"):
        validate_input(orders.limit(3), "y_reg")
    with pytest.raises(ValueError, match="no feature"):
        pf.trim(orders.select("o_orderkey", "near_const", "y_reg"), "y_reg")
    with pytest.raises(ValueError, match="no rows"):
        pf.trim(orders.where("false"), "y_reg")
    assert validate_input(orders, "mostly_null").startswith("warn")


def test_nan_and_duplicates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 3.0), (2, 3.0)], "k int, v double")
    clean = nan_to_null(df)
    assert clean.where("v is null").count() == 2
    assert rows.dedup_rows(clean).count() == 2
    first = rows.dedup_by_key(df.withColumn("o", F.monotonically_increasing_id()), ["k"])
    assert first.count() == 2 and rows.dedup_by_key(clean, ["absent"]).count() == 2


def test_keep_cols_override_the_identifier_rules(orders):
    _, report = pf.trim(orders, "y_reg", keep_cols=["row_num"])
    assert "row_num" not in report.dropped and "o_orderkey" in report.id_like


def test_unreadable_cells_are_missing_at_scoring(spark, orders):
    from tabloom.plans.prepare import Preparer

    raw = orders.select("o_orderkey", "price", "spiky", "shop", "y_reg")
    model = Preparer("y_reg", key_cols=["o_orderkey"], trees=5, top_n=99).fit(raw).model
    text = raw.withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string")))
    blank = raw.withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("price")))
    found = lambda df: sorted(map(tuple, model.features(df, ["o_orderkey"]).collect()))
    assert found(text) == found(blank)


def test_levels_that_differ_in_case_can_be_prepared(spark, orders):
    from tabloom.plans.prepare import Preparer

    raw = orders.select("o_orderkey", "spiky", "y_bin", F.expr("CASE WHEN y_bin = 'big' THEN 'Yes' WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'No' END AS flag"))
    prepared = Preparer("y_bin", key_cols=["o_orderkey"], trees=5, top_n=99).fit(raw)
    assert {"flag_No", "flag_Yes", "flag_yes~2"} <= set(prepared.state.encoder.outputs)
    assert prepared.cleaned().count() == raw.count()
