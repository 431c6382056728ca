"""Queries that train models, and the whole preparation."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import q
from ..operators import histograms, learners as ln, search, svm
from ..operators.encode import fit_scaler
from ..operators.impute import fit_imputer
from ..operators.target import label_index, label_list
from ..plans.prepare import Preparer, assemble
from ..plans.run import load_outcome, run
from ..session import new_path, spread, staged
from ..sources.tables import read_csv, write_csv
from ..streaming.scoring import read_table_stream, score_stream, score_stream_batches
from .fixtures import messy, rounded, split, table, train_rows, union_all, with_messy, with_split
from .registry import check

_FEATURES = ["price", "spiky", "shop", "skewed"]


@dataclass
class Frames:
    train: DataFrame
    test: DataFrame
    features: list[str]
    n_classes: int

    def job(self, **options) -> ln.Job:
        task = "classification" if self.n_classes else "regression"
        return ln.Job(task, self.n_classes, **options)


def frames(spark: SparkSession, sf_dir: str, target: str) -> Frames:
    """All orders as filled and scaled vectors, split by key."""
    df = split(spark, sf_dir)
    labels = []
    if target == "y_reg":
        label = q(target).cast("double")
    else:
        labels = label_list(df, target)
        label = label_index(labels, q(target), df.schema[target].dataType)
    keep = ["_row_id", "_split", "_label"]
    df = df.select(q("o_orderkey").alias("_row_id"), "_split", label.alias("_label"), *_FEATURES)
    df = fit_imputer(train_rows(df), keep).transform(df)
    df = fit_scaler(train_rows(df), _FEATURES).transform(df)
    rows = spread(assemble(df, _FEATURES, keep), table(spark, sf_dir, "orders").count())
    train = rows.where(F.col("_split") == "train").drop("_split")
    test = rows.where(F.col("_split") == "test").drop("_split")
    return Frames(train, test, _FEATURES, len(labels))


_LABELS = {
    "y_bin": "CAST(CASE y_bin WHEN 'big' THEN 0 ELSE 1 END AS DOUBLE)",
    "y_cls": "CAST(CASE y_cls WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE)",
    "y_reg": "round(y_reg, 6) + 0.0",
}


def _well_formed(scored: DataFrame, n_classes: int) -> Column:
    """Probabilities that sum to 1 with the prediction at their largest, or a finite number."""
    if not n_classes:
        return F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < 1e300)
    p = F.col("probability")
    total = F.aggregate(p, F.lit(0.0), lambda x, y: x + y)
    inside = F.forall(p, lambda x: (x >= 0) & (x <= 1))
    return (F.size(p) == n_classes) & inside & (F.abs(total - 1) < 1e-9) & (p[F.col("prediction").cast("int")] == F.array_max(p))


def _beats_trivial(scored: DataFrame, n_classes: int) -> DataFrame:
    """One row: whether the model does better than the most frequent class, or than the mean."""
    y, p = F.col("_label"), F.col("prediction")
    if n_classes:
        shares = [F.avg((y == float(k)).cast("double")) for k in range(n_classes)]
        return scored.agg((F.avg((y == p).cast("double")) > F.greatest(*shares)).alias("beats_trivial"))
    return scored.agg((F.sum((y - p) * (y - p)) < F.var_pop(y) * F.count(y)).alias("beats_trivial"))


def judged(data: Frames, fitted, beats: bool = True) -> DataFrame:
    """Every test row with its label, whether its answer is well formed and whether the model is worth having."""
    scored = staged(fitted.transform(data.test).drop("features"), "scored")  # read twice, scored once
    out = scored.select("_row_id", (F.round("_label", 6) + F.lit(0.0)).alias("_label"), _well_formed(scored, data.n_classes).alias("valid"))
    return out.crossJoin(_beats_trivial(scored, data.n_classes)) if beats else out  # one row


def _judged_sql(target: str, beats: bool = True, more: str = "") -> str:
    flags = "TRUE AS valid" + (", TRUE AS beats_trivial" if beats else "") + more
    return with_split(f"SELECT o_orderkey AS _row_id, {_LABELS[target]} AS _label, {flags} FROM s WHERE _split = 'test'")


@contextmanager
def _cached(df: DataFrame):
    """Learners pass over their rows many times."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _register(kind: str, target: str, names: list[str], beats: bool = True) -> None:
    """Each model with the library's settings."""
    for name in names:

        def query(spark, sf_dir, name=name):
            data = frames(spark, sf_dir, target)
            with _cached(data.train) as train:
                fitted = ln.fit_learner(name, train, data.job())
            return judged(data, fitted, beats)

        query.__name__ = f"{kind}_{name}"
        check(query.__name__, _judged_sql(target, beats))(query)


_register("classify", "y_bin", ln.CLASS_MODELS)
_register("classify3", "y_cls", ["linear_svc", "gradient_boosting", "adaboost"], beats=False)  # these labels are noise
_register("regress", "y_reg", [n for n in ln.NUMBER_MODELS if n not in ("ridge", "lasso", "linear_regression")])

# -- linear models with a closed form -------------------------------------------------------------

_LINE = """, d AS (SELECT price_twin / 100000 AS x, y_reg AS y FROM m),
    g AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM d)"""


def _one_feature(spark, sf_dir) -> DataFrame:
    df = messy(spark, sf_dir).selectExpr("price_twin / 100000 AS x", "y_reg AS _label")
    return assemble(df, ["x"], ["_label"])


def _line(spark, estimator, rows: DataFrame) -> DataFrame:
    fit = estimator.fit(rows)
    return spark.createDataFrame(
        [(round(float(fit.coefficients[0]), 4), round(float(fit.intercept), 3))], "slope double, intercept double"
    )


def _slope_sql(slope: str) -> str:
    return with_messy(
        f"{_LINE} SELECT round({slope}, 4) AS slope, round(my - {slope} * mx, 3) AS intercept FROM g"
    )


@check("linear_coeffs", _slope_sql("(sxy / sxx)"))
def linear_coeffs(spark, sf_dir):
    rows = _one_feature(spark, sf_dir)
    return _line(spark, ln._number_estimator("linear_regression", rows, {}), rows)


@check("ridge_coeffs", _slope_sql("(sxy / (sxx + 100))"))
def ridge_coeffs(spark, sf_dir):
    rows = _one_feature(spark, sf_dir)
    return _line(spark, ln.ridge(rows, 100.0), rows)


@check("lasso_coeffs", _slope_sql("((sxy / n - 1.0) / (sxx / n))"))
def lasso_coeffs(spark, sf_dir):
    rows = _one_feature(spark, sf_dir)
    return _line(spark, ln._number_estimator("lasso", rows, {"alpha": 1.0}), rows)


# -- squared hinge, histograms and node tables against SQL -------------------------------------------

_SVM_C = 1e-6


@check(
    "svm_coeffs",
    with_messy(
        f""", d AS (SELECT price_twin / 1000000 AS x, CASE WHEN o_totalprice > 250000 THEN 1.0E0 ELSE -1.0E0 END AS y
          FROM m JOIN (SELECT o_orderkey AS k, o_totalprice FROM orders) ON k = o_orderkey),
        g AS (SELECT count(*) + 1 / (2 * {_SVM_C}) AS n, sum(x) AS sx, sum(x * x) + 1 / (2 * {_SVM_C}) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM d)
        SELECT round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) AS slope, round((sxx * sy - sx * sxy) / (n * sxx - sx * sx), 6) AS intercept FROM g"""
    ),
)
def svm_coeffs(spark, sf_dir):
    """With so small a C every row is inside the margin, where squared hinge is squared error and the optimum has a closed form."""
    df = messy(spark, sf_dir).selectExpr("price_twin / 1000000 AS x", "CASE WHEN y_bin = 'big' THEN 1.0D ELSE 0.0D END AS _label")
    w = svm.solve(assemble(df, ["x"], ["_label"]), [svm.Problem(1)], _SVM_C, tolerance=1e-10)
    return spark.createDataFrame([(round(float(w[0, 0]), 6), round(float(w[1, 0]), 6))], "slope double, intercept double")


_HIST_COLUMNS = ["price", "spiky", "shop"]
_HIST_PENALTY = 1.0


def _hist_rows(spark, sf_dir, label: str) -> DataFrame:
    """Raw columns, missing values included."""
    x = F.array(*[F.coalesce(q(c).cast("double"), F.lit(float("nan"))) for c in _HIST_COLUMNS])
    return messy(spark, sf_dir).select(array_to_vector(x).alias("features"), F.expr(label).alias("_label"))


_BINNED_SQL = (
    ", raw AS ("
    + union_all([f"SELECT o_orderkey, {i} AS feature, CAST({c} AS DOUBLE) AS x FROM m" for i, c in enumerate(_HIST_COLUMNS)])
    + f"), ends AS (SELECT feature, list_distinct(quantile_cont(x, [{', '.join(f'{k}.0E0 / 255' for k in range(1, 255))}])) AS e FROM raw GROUP BY feature),"
    + " binned AS (SELECT o_orderkey, feature, CASE WHEN x IS NULL THEN 255 ELSE len(list_filter(e, lambda t: t < x)) END AS bin FROM raw JOIN ends USING (feature))"
)


def _gains_sql(name: str, slopes: str, below: str, least: float, penalty: float) -> str:
    """Gains of all splits of the root from `slopes`: (o_orderkey, unit, g, h); `below` is the sum that gradients are divided by."""
    return f"""{name}_cells AS (SELECT unit, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM binned JOIN {slopes} USING (o_orderkey) GROUP BY unit, feature, bin),
    {name}_sums AS (SELECT *, sum(g) OVER f AS ag, sum(h) OVER f AS ah, sum(n) OVER f AS an, sum(g) OVER u AS ug, sum(h) OVER u AS uh, sum(n) OVER u AS un,
        sum(CASE WHEN bin = 255 THEN g ELSE 0 END) OVER f AS mg, sum(CASE WHEN bin = 255 THEN h ELSE 0 END) OVER f AS mh, sum(CASE WHEN bin = 255 THEN n ELSE 0 END) OVER f AS mn
        FROM {name}_cells WINDOW f AS (PARTITION BY unit, feature), u AS (PARTITION BY unit, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    {name}_sides AS (SELECT unit, feature, bin, false AS missing_left, ug AS lg, uh AS lh, un AS ln, ag, ah, an FROM {name}_sums WHERE bin < 255
        UNION ALL SELECT unit, feature, bin, true, ug + mg, uh + mh, un + mn, ag, ah, an FROM {name}_sums WHERE bin < 255 AND mn > 0),
    {name} AS (SELECT unit, feature, bin, missing_left, lg, lh, ln, ag, ah, an,
        lg * lg / (l{below} + {penalty}) + (ag - lg) * (ag - lg) / (a{below} - l{below} + {penalty}) - ag * ag / (a{below} + {penalty}) AS gain
        FROM {name}_sides WHERE ln > 0 AND ln < an AND l{below} >= {least} AND a{below} - l{below} >= {least})"""


def _shares(df: DataFrame) -> DataFrame:
    """Gains as shares of the best one of their round and output, to six places."""
    best = F.max("gain").over(Window.partitionBy("round", "unit"))
    return df.select(
        F.col("round").cast("long").alias("round"), *[F.col(c).cast("long").alias(c) for c in ("unit", "feature", "bin")], "missing_left",
        (F.round(F.col("gain") / best, 6) + F.lit(0.0)).alias("gain"),
    )


_SHARE_SQL = "SELECT CAST(round_ AS BIGINT) AS round, CAST(unit AS BIGINT) AS unit, CAST(feature AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, missing_left, round(gain / max(gain) OVER (PARTITION BY round_, unit), 6) + 0.0 AS gain FROM"


@check(
    "hist_split_gains",
    with_messy(
        _BINNED_SQL
        + ", s0 AS (SELECT o_orderkey, 0 AS unit, (SELECT avg(y_reg) FROM m) - y_reg AS g, 1.0E0 AS h FROM m), "
        + _gains_sql("g0", "s0", "h", 1.0, _HIST_PENALTY)
        + """, best AS (SELECT * FROM g0 ORDER BY gain DESC, feature, bin, missing_left LIMIT 1),
        s1 AS (SELECT o_orderkey, 0 AS unit, s0.g + CASE WHEN (b.bin = 255 AND missing_left) OR b.bin <= best.bin THEN -0.3E0 * lg / (lh + 1) ELSE -0.3E0 * (ag - lg) / (ah - lh + 1) END AS g, 1.0E0 AS h
            FROM s0 JOIN binned b USING (o_orderkey) JOIN best ON best.feature = b.feature), """
        + _gains_sql("g1", "s1", "h", 1.0, _HIST_PENALTY)
        + f" {_SHARE_SQL} (SELECT 0 AS round_, * FROM g0 UNION ALL SELECT 1 AS round_, * FROM g1)"
    ),
)
def hist_split_gains(spark, sf_dir):
    """Every split of the roots of two rounds of second-order boosting, missing values on either side."""
    settings = histograms.hist_settings("number", 1, rounds=2, depth=1)
    return _shares(histograms.gain_table(_hist_rows(spark, sf_dir, "y_reg"), settings))


@check(
    "softmax_split_gains",
    with_messy(
        _BINNED_SQL
        + """, classes AS (SELECT * FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P')) AS c(unit, name)),
        s0 AS (SELECT o_orderkey, unit, (SELECT count(*) FROM m AS o WHERE o.y_cls = name) / (SELECT CAST(count(*) AS DOUBLE) FROM m)
            - CASE WHEN y_cls = name THEN 1 ELSE 0 END AS g, 1.0E0 AS h FROM m, classes), """
        + _gains_sql("g0", "s0", "n", 0.0, 0.0)
        + f" {_SHARE_SQL} (SELECT 0 AS round_, * FROM g0)"
    ),
)
def softmax_split_gains(spark, sf_dir):
    """Splits of the first round's roots, one tree per class on the residuals of the class shares."""
    settings = histograms.gradient_settings("classes", 3, rounds=1, depth=1)
    rows = _hist_rows(spark, sf_dir, "CASE y_cls WHEN 'F' THEN 0.0D WHEN 'O' THEN 1.0D ELSE 2.0D END")
    return _shares(histograms.gain_table(rows, settings))


_TREE_COLUMNS = ["spiky", "shop", "total"]


def _tree_level(name: str, rows: str) -> str:
    """The best split of every node of `rows`: (node, k, y) with the columns as 32-bit floats, by Gini impurity."""
    long = union_all([f"SELECT node, {i} AS feature, CAST({c} AS DOUBLE) AS x, y FROM {rows}" for i, c in enumerate(_TREE_COLUMNS)])
    return f"""{name}_v AS (SELECT node, feature, x, count(*) AS n, sum(y) AS p FROM ({long}) GROUP BY node, feature, x),
    {name}_c AS (SELECT *, sum(n) OVER w AS ln, sum(p) OVER w AS lp, sum(n) OVER (PARTITION BY node, feature) AS an, sum(p) OVER (PARTITION BY node, feature) AS ap,
        lead(x) OVER (PARTITION BY node, feature ORDER BY x) AS next_x FROM {name}_v WINDOW w AS (PARTITION BY node, feature ORDER BY x ROWS UNBOUNDED PRECEDING)),
    {name}_b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, x) AS r FROM (SELECT *, CAST((lp * lp + (ln - lp) * (ln - lp)) AS DOUBLE) / ln
        + CAST(((ap - lp) * (ap - lp) + (an - ln - ap + lp) * (an - ln - ap + lp)) AS DOUBLE) / (an - ln) AS gain FROM {name}_c WHERE next_x IS NOT NULL)),
    {name} AS (SELECT node, feature, (x + next_x) / 2 AS cut, an AS n, ap AS p FROM {name}_b WHERE r = 1)"""


_TREE_ROWS = """, rows0 AS (SELECT 0 AS node, CAST(spiky AS REAL) AS spiky, CAST(shop AS REAL) AS shop, CAST(total AS REAL) AS total, y FROM
    (SELECT spiky, shop, floor(price_twin / 60000) AS total, CASE WHEN y_bin = 'big' THEN 1 ELSE 0 END AS y FROM m))"""


@check(
    "tree_nodes",
    with_messy(
        f"""{_TREE_ROWS}, {_tree_level('t0', 'rows0')},
        rows1 AS (SELECT CASE WHEN CASE feature WHEN 0 THEN spiky WHEN 1 THEN shop ELSE total END <= cut THEN 1 ELSE 2 END AS node, spiky, shop, total, y FROM rows0, t0),
        {_tree_level('t1', 'rows1')}
        SELECT CAST(node AS BIGINT) AS node, CAST(feature AS BIGINT) AS feature, round(cut, 4) AS threshold, CAST(n AS BIGINT) AS n_rows,
            round(1 - (p * p + (n - p) * (n - p)) / (CAST(n AS DOUBLE) * n), 6) + 0.0 AS impurity FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1) WHERE p > 0 AND p < n"""
    ),
)
def tree_nodes(spark, sf_dir):
    """The root and its children of a decision tree grown to its end, which has neither a depth limit nor bins."""
    df = messy(spark, sf_dir).selectExpr(
        "o_orderkey AS _row_id", "spiky", "CAST(shop AS DOUBLE) AS shop", "floor(price_twin / 60000) AS total", "CASE WHEN y_bin = 'big' THEN 1.0D ELSE 0.0D END AS _label"
    )
    rows = df.select("_row_id", "_label", array_to_vector(F.array(*[q(c).cast("double") for c in _TREE_COLUMNS])).alias("features"))
    grown = ln.fit_learner("decision_tree", rows, ln.Job("classification", 2)).forest
    nodes = grown.first_levels(spark).where("feature >= 0")
    return rounded(
        nodes.select(
            F.col("node").cast("long").alias("node"), F.col("feature").cast("long").alias("feature"), F.col("threshold"),
            F.col("rows").cast("long").alias("n_rows"), "impurity",
        ).withColumn("threshold", F.round("threshold", 4)), 6, "impurity",
    )


# -- search and ensembles -------------------------------------------------------------------------

def _baselines_sql(models: list[str]) -> str:
    return union_all([f"SELECT 'baseline' AS stage, '{m}' AS model, 'ok' AS status, TRUE AS beats_trivial" for m in models])


def _baselines(spark, sf_dir, target: str, metric: str, floor: float) -> DataFrame:
    data = frames(spark, sf_dir, target)
    with _cached(data.train) as train:
        results = search.run_baselines(train, data.test, data.job(), metric)
    return search.scores_table(spark, results).select("stage", "model", "status", (F.col("score") > floor).alias("beats_trivial"))


@check("baseline_models", _baselines_sql(ln.CLASS_MODELS))
def baseline_models(spark, sf_dir):
    """All classifiers; the classes of y_bin are of nearly equal size."""
    return _baselines(spark, sf_dir, "y_bin", "accuracy", 0.55)


@check("baseline_regressors", _baselines_sql(ln.NUMBER_MODELS))
def baseline_regressors(spark, sf_dir):
    return _baselines(spark, sf_dir, "y_reg", "r2", 0.0)


@check("random_search", "SELECT 'tuned' AS stage, 'ridge' AS model, 'ok' AS status, TRUE AS beats_trivial")
def random_search(spark, sf_dir):
    """The whole grid of ridge in five folds."""
    data = frames(spark, sf_dir, "y_reg")
    with _cached(data.train) as train:
        result = search.tune("ridge", train, data.test, data.job(), "r2")
    return search.scores_table(spark, [result]).select("stage", "model", "status", (F.col("score") > 0).alias("beats_trivial"))


#: Members of the ensemble queries; a run takes the best of all models, which train for minutes.
_MEMBERS = {"y_bin": ["logistic_regression", "random_forest", "linear_svc"], "y_reg": ["ridge", "random_forest", "decision_tree"]}


def _ensemble(spark, sf_dir, target: str, metric: str, stacked: bool) -> DataFrame:
    data = frames(spark, sf_dir, target)
    with _cached(data.train) as train:
        members = search.rank(search.run_baselines(train, data.test, data.job(), metric, _MEMBERS[target]))
        fitted = search.build_stacking(members, train, data.job()) if stacked else search.build_voting(members, data.job())
    return judged(data, fitted)


@check("voting_classifier", _judged_sql("y_bin"))
def voting_classifier(spark, sf_dir):
    return _ensemble(spark, sf_dir, "y_bin", "accuracy", stacked=False)


@check("voting_regressor", _judged_sql("y_reg"))
def voting_regressor(spark, sf_dir):
    return _ensemble(spark, sf_dir, "y_reg", "r2", stacked=False)


@check("stacking_classifier", _judged_sql("y_bin"))
def stacking_classifier(spark, sf_dir):
    return _ensemble(spark, sf_dir, "y_bin", "accuracy", stacked=True)


@check("stacking_regressor", _judged_sql("y_reg"))
def stacking_regressor(spark, sf_dir):
    return _ensemble(spark, sf_dir, "y_reg", "r2", stacked=True)


@check("model_save_load", _judged_sql("y_bin", more=", TRUE AS same"))
def model_save_load(spark, sf_dir):
    """A forest read back answers every test row as the one that was saved."""
    data = frames(spark, sf_dir, "y_bin")
    path = new_path(spark, "model")
    fitted = ln.fit_learner("random_forest", data.train, data.job(), {"n_estimators": 20})
    fitted.save(path)
    restored = ln.load_model(spark, path)
    first = fitted.transform(data.test).select("_row_id", F.col("probability").alias("_first"))
    again = restored.transform(data.test).select("_row_id", "probability")
    same = first.join(again, "_row_id").select("_row_id", (F.col("_first") == F.col("probability")).alias("same"))
    return judged(data, restored).join(same, "_row_id")


# -- the whole preparation ------------------------------------------------------------------------


def _preparer(target: str, **options) -> Preparer:
    settings = {"key_cols": ["o_orderkey"], "leakage_cols": ["price_twin"], **options}
    return Preparer(target, **settings)


def _one_target(spark, sf_dir, target: str) -> DataFrame:
    others = [c for c in ("y_cls", "y_imb", "y_bin", "y_reg") if c != target]
    return messy(spark, sf_dir).drop(*others)


_SCORED = ["price", "spiky", "shop"]


def _z(c: str) -> str:
    return f"round((x.{c} - st.{c}_m) / st.{c}_s, 5) + 0.0 AS {c}"


def _fence(c: str) -> str:
    return f"""least(greatest(f.{c}, fe.{c}_1 - 1.5 * (fe.{c}_3 - fe.{c}_1)), fe.{c}_3 + 1.5 * (fe.{c}_3 - fe.{c}_1)) AS {c}"""


@check(
    "score_features",
    with_split(
        """, f AS (SELECT o_orderkey, _split, coalesce(price, (SELECT avg(price) FROM t)) AS price, spiky, CAST(shop AS DOUBLE) AS shop FROM s),
        fe AS (SELECT """
        + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in _SCORED)
        + " FROM f WHERE _split = 'train'), x AS (SELECT o_orderkey, _split, "
        + ", ".join(_fence(c) for c in _SCORED)
        + ", CASE WHEN f.price > fe.price_3 + 1.5 * (fe.price_3 - fe.price_1) THEN 1 ELSE 0 END AS massive FROM f, fe), st AS (SELECT "
        + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in _SCORED)
        + " FROM x WHERE _split = 'train') SELECT o_orderkey, "
        + ", ".join(_z(c) for c in _SCORED)
        + ', CAST(massive AS DOUBLE) AS "Is_Massive_price" FROM x, st'
    ),
)
def score_features(spark, sf_dir):
    """Fit on the split's training rows, apply to every raw row."""
    df = messy(spark, sf_dir).select("o_orderkey", *_SCORED, "y_reg")
    model = _preparer("y_reg", leakage_cols=[], top_n=99).fit(df).model
    out = model.features(df.drop("y_reg"), ["o_orderkey"])
    return rounded(out, 5, *_SCORED)


def _cleaned_sql(target: str) -> str:
    return with_split(f"SELECT CAST(o_orderkey AS VARCHAR) AS _row_id, _split, {target}, TRUE AS filled FROM s")


def _cleaned(spark, sf_dir, target: str) -> DataFrame:
    """Every row with its side and target, and whether all its features, scaled and encoded, are there."""
    prepared = _preparer(target).fit(_one_target(spark, sf_dir, target))
    present = [q(c).isNotNull() & ~F.isnan(q(c)) for c in prepared.state.features]
    return prepared.cleaned().select("_row_id", "_split", q(target), reduce(and_, present).alias("filled"))


@check("full_prepare", _cleaned_sql("y_bin"))
def full_prepare(spark, sf_dir):
    return _cleaned(spark, sf_dir, "y_bin")


@check("full_prepare_balanced", _cleaned_sql("y_imb"))
def full_prepare_balanced(spark, sf_dir):
    """Severe imbalance: the training rows are over-sampled."""
    return _cleaned(spark, sf_dir, "y_imb")


@check("full_prepare_log")
def full_prepare_log(spark, sf_dir):
    return _preparer("y_reg").fit(_one_target(spark, sf_dir, "y_reg")).model.log(spark)


def _scoring_model(spark, sf_dir):
    prepared = _preparer("y_reg").fit(_one_target(spark, sf_dir, "y_reg"))
    fitted = ln.fit_learner("linear_regression", prepared.train, ln.Job("regression"))
    return prepared.model, fitted


@check("score_batch", with_messy("SELECT o_orderkey, TRUE AS finite, TRUE AS beats_trivial FROM m"))
def score_batch(spark, sf_dir):
    """Raw rows scored by a state that was saved and read back."""
    model, fitted = _scoring_model(spark, sf_dir)
    path = new_path(spark, "state")
    model.save(path)
    raw = _one_target(spark, sf_dir, "y_reg")
    scored = type(model).load(spark, path).score(fitted, raw.drop("y_reg"), ["o_orderkey"]).withColumnRenamed("y_reg", "prediction")
    both = scored.join(raw.select("o_orderkey", F.col("y_reg").alias("_label")), "o_orderkey")
    return both.select("o_orderkey", _well_formed(both, 0).alias("finite")).crossJoin(_beats_trivial(both, 0))  # one row


@check("score_stream", with_messy("SELECT o_orderkey, TRUE AS same FROM m"))
def score_stream_query(spark, sf_dir):
    """The same orders as files of a stream; equals the batch row for row."""
    model, fitted = _scoring_model(spark, sf_dir)
    raw = _one_target(spark, sf_dir, "y_reg").drop("y_reg")
    source, sink, log = (new_path(spark, n) for n in ("source", "sink", "log"))
    raw.repartition(4).write.parquet(source)
    score_stream(read_table_stream(spark, source, raw.schema), model, fitted, sink, log, ["o_orderkey"]).awaitTermination()
    batch = model.score(fitted, raw, ["o_orderkey"]).withColumnRenamed("y_reg", "_batch")
    streamed = spark.read.parquet(sink)
    return streamed.join(batch, "o_orderkey").select("o_orderkey", (F.abs(F.col("y_reg") - F.col("_batch")) <= 1e-9 * F.abs("_batch")).alias("same"))


@check("predictions_csv", with_messy("SELECT o_orderkey, TRUE AS same FROM m"))
def predictions_csv(spark, sf_dir):
    """Predictions written as CSV with a header and read back."""
    model, fitted = _scoring_model(spark, sf_dir)
    scored = model.score(fitted, _one_target(spark, sf_dir, "y_reg").drop("y_reg"), ["o_orderkey"])
    path = new_path(spark, "predictions")
    write_csv(scored, path)
    back = read_csv(spark, path).select("o_orderkey", F.col("y_reg").alias("_read"))
    return scored.join(back, "o_orderkey").select("o_orderkey", (F.abs(F.col("y_reg") - F.col("_read")) <= 1e-9 * F.abs("y_reg")).alias("same"))


@check("outcome_bundle", with_messy("SELECT o_orderkey, TRUE AS same FROM m"))
def outcome_bundle(spark, sf_dir):
    """A whole outcome saved in one folder and read back predicts as the one that was saved."""
    raw = _one_target(spark, sf_dir, "y_reg")
    outcome = run(raw, _preparer("y_reg"), ["linear_regression", "ridge"], tune_top=1)
    path = new_path(spark, "outcome")
    outcome.save(path)
    first = outcome.predict(raw, ["o_orderkey"]).withColumnRenamed("y_reg", "_first")
    again = load_outcome(spark, path).predict(raw.drop("y_reg"), ["o_orderkey"])
    return again.join(first, "o_orderkey").select("o_orderkey", (F.abs(F.col("y_reg") - F.col("_first")) <= 1e-9 * F.abs("_first")).alias("same"))


@check("score_stream_knn", with_messy("SELECT o_orderkey, TRUE AS same FROM m"))
def score_stream_knn(spark, sf_dir):
    """A stream scored batch by batch with neighbours searched by joins equals the batch row for row."""
    prepared = _preparer("y_bin").fit(_one_target(spark, sf_dir, "y_bin"))
    fitted = ln.fit_learner("knn", prepared.train, ln.Job("classification", 2))
    fitted.broadcast_bytes = 0
    raw = _one_target(spark, sf_dir, "y_bin").drop("y_bin")
    source, sink, log = (new_path(spark, n) for n in ("source", "sink", "log"))
    raw.repartition(3).write.parquet(source)
    score_stream_batches(read_table_stream(spark, source, raw.schema), prepared.model, fitted, sink, log, ["o_orderkey"]).awaitTermination()
    streamed = spark.read.parquet(sink).select("o_orderkey", F.col("y_bin").alias("_streamed"))
    return prepared.model.score(fitted, raw, ["o_orderkey"]).join(streamed, "o_orderkey").select("o_orderkey", (F.col("y_bin") == F.col("_streamed")).alias("same"))


@check("full_run")
def full_run(spark, sf_dir):
    """Preparation, baselines, stop rules, tuning, ensembles, choice."""
    outcome = run(
        _one_target(spark, sf_dir, "y_reg"), _preparer("y_reg"), ["linear_regression", "ridge", "decision_tree"],
        folds=2, points=2, tune_top=2,
    )
    return outcome.scores()
