"""Trees, forests, boosting and the squared-hinge SVM against plain Python."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import forest, histograms as hist, learners as ln, svm
from tabloom.session import new_path


def made(seed, n, classes, missing=False):
    """Three features, ties included; the label hangs on two of them."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(0, 6, n), rng.normal(size=n), rng.integers(0, 40, n) / 7]
    raw = x[:, 0] + 2 * np.sin(2 * x[:, 1]) + rng.normal(scale=0.5, size=n)
    y = np.digitize(raw, np.quantile(raw, np.arange(1, classes) / classes)).astype(float) if classes else raw
    if missing:
        x[rng.random(n) < 0.2, 1] = np.nan
    return x, y


def frame(spark, x, y, parts=4):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_row_id long, v array<double>, _label double").repartition(parts)
    return df.select("_row_id", "_label", array_to_vector("v").alias("features"))


def gini(y, classes):
    return 1 - sum((np.mean(y == k)) ** 2 for k in range(classes))


def plain_tree(x, y, classes, depth, least):
    """Rows, impurity, feature and cut of every node, root first, then left before right."""
    bad = (lambda v: gini(v, classes)) if classes else np.var
    found = (len(y), bad(y), None, None)
    if len(y) < least or bad(y) <= 1e-12 or depth == 0:
        return [found]
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            score = left.sum() * bad(y[left]) + (~left).sum() * bad(y[~left])
            if best is None or score < best[0] - 1e-9:
                best = (score, f, (float(a) + float(b)) / 2)
    if best is None:
        return [found]
    left = x[:, best[1]] <= best[2]
    below = None if depth is None else depth - 1
    return [(*found[:2], best[1], best[2])] + plain_tree(x[left], y[left], classes, below, least) + plain_tree(x[~left], y[~left], classes, below, least)


def walked(nodes, i=0):
    r = nodes[i]
    own = (r["rows"], r["impurity"], r["feature"] if r["feature"] >= 0 else None, r["threshold"] if r["feature"] >= 0 else None)
    return [own] if r["feature"] < 0 else [own, *walked(nodes, r["left"]), *walked(nodes, r["right"])]


@pytest.mark.parametrize("classes,depth,least", [(3, None, 2), (2, 4, 2), (0, None, 10), (0, 3, 2)])
def test_tree_equals_plain_search(spark, classes, depth, least):
    x, y = made(1, 160, classes)
    x = x.astype(np.float32)
    grown = forest.fit(frame(spark, x, y), forest.Growth(classes, depth=depth, least_split=least), new_path(spark, "tree"))
    nodes = {r["node"]: r for r in grown.nodes(spark).collect()}
    got, expected = walked(nodes), plain_tree(x, y, classes, depth, least)
    assert [g[0] for g in got] == [e[0] for e in expected]
    for g, e in zip(got, expected):
        assert math.isclose(g[1], e[1], abs_tol=1e-7) and g[2] == e[2] and (e[3] is None or math.isclose(g[3], e[3], rel_tol=1e-6))


def test_no_depth_limit_differs_from_ten(spark):
    x, y = made(2, 3000, 2)
    train = frame(spark, x, y)
    job = ln.Job("classification", 2)
    deep, ten = (ln.fit_learner("decision_tree", train, job, {"max_depth": d}).forest for d in (None, 10))
    assert deep.nodes(spark).where("feature < 0 AND impurity > 1e-9").isEmpty()  # grown to the end
    assert not ten.nodes(spark).where("feature < 0 AND impurity > 1e-9").isEmpty()
    split = ln.fit_learner("decision_tree", train, job, {"min_samples_split": 10}).forest.nodes(spark)
    assert split.where("feature >= 0 AND rows < 10").isEmpty() and not split.where("feature < 0 AND rows < 10").isEmpty()


@pytest.mark.parametrize("classes", [0, 3])
def test_large_nodes_are_split_on_histograms_first(spark, monkeypatch, classes):
    x, y = made(3, 2500, classes)
    train = frame(spark, x, y)
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 300)
    grown = forest.fit(train, forest.Growth(classes, 3, True, 2 if classes else 0), new_path(spark, "forest"))
    nodes = grown.nodes(spark)
    assert nodes.where("slot = -1").count() > 3 and nodes.where("slot >= 0 AND rows > 300").isEmpty()
    tops = {(r["tree"], r["node"]): r for r in nodes.where("slot = -1").collect()}
    roots = {(r["tree"], r["slot"]): r["rows"] for r in nodes.where("slot >= 0 AND node = 0").collect()}
    for (t, _), r in tops.items():  # rows of the children add up, in the table above and below the cut
        if r["feature"] >= 0:
            below = [roots[t, -2 - c] if c <= -2 else tops[t, c]["rows"] for c in (r["left"], r["right"])]
            assert sum(below) == r["rows"]
    scored = grown.transform(train).select("_label", "prediction").toPandas()
    if classes:
        assert (scored["_label"] == scored["prediction"]).mean() > 0.85
    else:
        assert 1 - ((scored["_label"] - scored["prediction"]) ** 2).mean() / scored["_label"].var() > 0.9


def test_no_row_or_task_holds_more_than_a_subtree(spark, monkeypatch):
    x, y = made(11, 2500, 0)
    train = frame(spark, x, y)
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 300)
    path = new_path(spark, "forest")
    grown = forest.fit(train, forest.Growth(0, 3, True), path)
    parts = spark.read.parquet(f"{path}/parts")
    assert parts.count() > 20 and parts.where("length(feature) > 4 * 2 * 300").isEmpty()  # once a row was a whole tree
    assert grown.nodes(spark).where("slot >= 0 AND node = 0").count() == parts.count()
    local = path.removeprefix("file://")
    forest._KEPT.clear()
    kept = forest.votes(x.astype(np.float32), local, 3)
    assert set(forest._KEPT) == {f"{local}/tops", f"{local}/parts"}
    forest._KEPT.clear()
    monkeypatch.setattr(forest, "CACHE_BYTES", 1)
    read_again = forest.votes(x.astype(np.float32), local, 3)
    assert not forest._KEPT and np.allclose(kept, read_again)
    got = {r["_row_id"]: r["prediction"] for r in grown.transform(train).collect()}
    assert np.allclose([got[i] for i in range(len(x))], kept[:, 0] / 3)


def test_importances_without_nodes_are_those_of_the_nodes(spark, monkeypatch):
    x, y = made(12, 1500, 2)
    train = frame(spark, x, y)
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 300)
    growth = forest.Growth(2, 4, True, 1)
    whole, bare = (forest.fit(train, growth, new_path(spark, "forest"), keep) for keep in (True, False))
    names = ["a", "b", "c"]
    a, b = ({r["feature"]: r["importance"] for r in g.importances(spark, names).collect()} for g in (whole, bare))
    per_tree = whole.nodes(spark).where("feature >= 0").groupBy("tree", "feature").agg(F.sum("decrease").alias("d")).toPandas()
    shares = (per_tree.assign(s=per_tree.d / per_tree.groupby("tree").d.transform("sum")).groupby("feature").s.sum() / 4).to_dict()
    assert a == b and all(math.isclose(a[n], shares[i], rel_tol=1e-9) for i, n in enumerate(names))


def test_forest_does_not_hang_on_the_order_of_rows(spark):
    x, y = made(4, 400, 2)
    growth = forest.Growth(2, 4, True, 1)
    one, two = (forest.fit(frame(spark, x, y, parts), growth, new_path(spark, "forest")).nodes(spark) for parts in (1, 5))
    key = ["tree", "slot", "node", "feature", "threshold", "rows"]
    assert sorted(map(tuple, one.select(key).collect())) == sorted(map(tuple, two.select(key).collect()))


def test_draws_are_poisson():
    w = forest.drawn(np.arange(200_000), 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert not np.array_equal(w, forest.drawn(np.arange(200_000), 4, 42))


def test_importances_favour_what_tells(spark):
    x, y = made(5, 1500, 0)
    x = np.c_[x[:, :2], np.random.default_rng(1).normal(size=len(x))]
    grown = forest.fit(frame(spark, x, y), forest.Growth(0, 10, True), new_path(spark, "forest"))
    got = {r["feature"]: r["importance"] for r in grown.importances(spark, ["a", "b", "noise", "absent"]).collect()}
    assert math.isclose(sum(got.values()), 1) and got["noise"] < min(got["a"], got["b"]) and got["absent"] == 0


# --- boosting -------------------------------------------------------------------------------


@pytest.mark.parametrize("task,outputs", [("number", 1), ("binary", 1), ("classes", 3)])
def test_both_ways_of_searching_a_level_give_the_same_trees(spark, monkeypatch, task, outputs):
    x, y = made(6, 500, {"number": 0, "binary": 2, "classes": 3}[task], missing=True)
    for made_by in (hist.hist_settings, hist.gradient_settings):
        settings = made_by(task, outputs, rounds=2, depth=3)
        monkeypatch.setattr(hist, "DRIVER_CELLS", 1 << 22)
        small = hist.fit(frame(spark, x, y, 3), settings)
        monkeypatch.setattr(hist, "DRIVER_CELLS", 0)
        assert hist.fit(frame(spark, x, y, 2), settings) == small


def test_boosting_reads_rows_in_blocks(spark):
    x, y = made(13, 700, 0, missing=True)
    train = frame(spark, x, y, 2)
    edges = hist.bin_edges(train, 3, len(y))
    table = hist.binned_rows(train, edges, [0.5])
    assert table.count() <= 2  # once a row each
    trees = [[hist.Tree(feature=[1, -1, 0, -1, -1], bin=[3, 0, 2, 0, 0], threshold=[0.0] * 5, missing_left=[True] + [False] * 4,
                        left=[1, 0, 3, 0, 0], right=[2, 0, 4, 0, 0], value=[0.0, 1.0, 0.0, 2.0, 3.0], gain=[0.0] * 5)]]
    for r in hist.refreshed(table, 3, 1, trees).collect():
        bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, 3)
        left = (bins[:, 1] <= 3) | (bins[:, 1] == hist.MISSING)
        expected = 0.5 + np.where(left, 1.0, np.where(bins[:, 0] <= 2, 2.0, 3.0))
        assert np.array_equal(np.frombuffer(r["margins"]), expected) and len(r["label"]) == 8 * len(bins)


def plain_boost(x, y, rounds, rate, depth, penalty):
    """Second-order boosting of squared error over distinct values; margins of the training rows."""
    f = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, node = f - y, [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for rows in node:
                best = (1e-6, None)
                for c in range(x.shape[1]):
                    for v in np.unique(x[rows, c])[:-1]:
                        left = x[rows, c] <= v
                        a, b, whole = g[rows][left].sum(), g[rows][~left].sum(), g[rows].sum()
                        gain = a * a / (left.sum() + penalty) + b * b / ((~left).sum() + penalty) - whole**2 / (len(rows) + penalty)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, left)
                below += [rows] if best[1] is None else [rows[best[1]], rows[~best[1]]]
            node = below
        for rows in node:
            f[rows] -= rate * g[rows].sum() / (len(rows) + penalty)
    return f


def test_second_order_boosting_equals_plain(spark):
    x, y = made(7, 200, 0)
    x[:, 1] = np.round(x[:, 1], 1)
    model = hist.fit(frame(spark, x, y), hist.hist_settings("number", 1, rounds=4, depth=2))
    got = {r["_row_id"]: r["prediction"] for r in model.transform(frame(spark, x, y)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], plain_boost(x, y, 4, 0.3, 2, 1.0), atol=1e-6)


def test_missing_values_go_where_they_gain(spark):
    x = np.array([[np.nan if i % 4 == 0 else i % 4] for i in range(200)], dtype=float)
    for value in (-3.0, 9.0):
        y = np.where(np.isnan(x[:, 0]), value, x[:, 0])
        model = hist.fit(frame(spark, x, y), hist.hist_settings("number", 1, rounds=30, depth=2))
        got = {r["_row_id"]: r["prediction"] for r in model.transform(frame(spark, x, y)).collect()}
        assert np.allclose([got[i] for i in range(len(y))], y, atol=0.2)


def test_softmax_boosting_over_refreshed_margins(spark, monkeypatch):
    monkeypatch.setattr(hist, "REFRESH", 2)
    x, y = made(8, 600, 3)
    often = hist.fit(frame(spark, x, y), hist.gradient_settings("classes", 3, rounds=7))
    monkeypatch.setattr(hist, "REFRESH", 100)
    assert hist.fit(frame(spark, x, y), hist.gradient_settings("classes", 3, rounds=7)) == often
    got = often.transform(frame(spark, x, y)).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in got)
    assert np.mean([r["prediction"] == r["_label"] for r in got]) > 0.7


# --- SVM ------------------------------------------------------------------------------------


def test_svm_gradient_vanishes_for_all_problems(spark):
    x, y = made(9, 400, 3)
    df = frame(spark, x, y).withColumn("_fold", (F.col("_row_id") % 2).cast("int"))
    problems = [svm.Problem(p, f) for f in (-1, 0, 1) for p in range(3)]
    w = svm.solve(df, problems, 0.7, F.col("_fold"))
    z = np.c_[x, np.ones(len(x))]
    for p, at in zip(problems, w.T):
        part = np.arange(len(y)) % 2 != p.without
        sign = np.where(y[part] == p.positive, 1.0, -1.0)
        grad = lambda v: v - 2 * 0.7 * z[part].T @ (sign * np.maximum(0, 1 - sign * (z[part] @ v)))  # noqa: B023, E731
        assert np.linalg.norm(grad(at)) <= 1.01e-6 * np.linalg.norm(grad(np.zeros(4)))


def test_svm_weights_count_as_repeats(spark):
    x, y = made(10, 120, 2)
    twice = frame(spark, np.r_[x, x[:30]], np.r_[y, y[:30]])
    weighted = frame(spark, x, y).withColumn("_weight", F.when(F.col("_row_id") < 30, 2.0).otherwise(1.0))
    a, b = (svm.solve(df, [svm.Problem(1)], 1.0, tolerance=1e-9) for df in (twice, weighted))
    assert np.allclose(a, b, atol=1e-6)


@pytest.mark.parametrize("classes,features", [(0, 0), (3, 0), (3, 2)])
def test_features_of_few_values_need_no_order(classes, features):
    """Tallied, swept or listed by their rare rows, features give the same tree; missing values go to the right."""
    rng = np.random.default_rng(5)
    x, y = made(12, 3000, classes)
    hot = rng.integers(0, 9, 3000)[:, None] == np.arange(9)
    x = np.c_[x, hot, rng.random(3000) < 0.4].astype(np.float32)
    x[rng.random(3000) < 0.1, 2] = np.nan
    w = rng.integers(1, 4, 3000).astype(float)
    values = [v if len(v) <= 100 else None for v in (np.unique(c) for c in x.T)]
    codes = [None if v is None else np.searchsorted(v, c).astype(np.uint8) for v, c in zip(values, x.T)]
    growth = forest.Growth(classes, features=features)
    coded = forest.Columns([np.ascontiguousarray(c) for c in x.T], codes, values)
    assert np.array_equal(coded.order(y, w), np.lexsort((w, y, *x.T)))
    swept, tallied = (forest.subtree(d, y, w, growth, 0, 1, 0) for d in (x, coded))
    for name in swept:
        assert np.array_equal(swept[name], tallied[name]), name


def test_rows_of_few_values_are_dealt_as_bytes(spark, monkeypatch):
    """A forest sends features of few values to its sub-trees as one byte a row, and its trees are those of the whole numbers."""
    x, y = made(13, 800, 0, missing=True)
    train = frame(spark, x, y)
    n, values = forest.few_values(train, 3)
    assert n == 800 and values[1] is None and len(values[0]) == 6 and len(values[2]) == 40
    blocks = forest.row_blocks(train, 3, None, values).collect()
    assert sum(len(b["x"]) for b in blocks) == 4 * 800 and sum(len(b["codes"]) for b in blocks) == 2 * 800
    first = forest.fit(train, forest.Growth(0, 3, True), new_path(spark, "forest")).nodes(spark).orderBy("tree", "node").collect()
    monkeypatch.setattr(forest, "few_values", lambda train, width: (800, [None] * width))
    assert first == forest.fit(train, forest.Growth(0, 3, True), new_path(spark, "forest")).nodes(spark).orderBy("tree", "node").collect()


def test_bin_edges_do_not_hang_on_the_number_of_rows(spark, monkeypatch):
    """Above EXACT_ROWS the edges are the exact quantiles too; a sketch once stood in for them."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=30_000).cumsum(), rng.integers(0, 40, 30_000), np.zeros(30_000), np.full(30_000, np.nan)]
    x[rng.random(30_000) < 0.1, 0] = np.nan
    train = spark.createDataFrame([(r.tolist(), 0.0) for r in x], "v array<double>, _label double").select(array_to_vector("v").alias("features"), "_label")
    one = hist.bin_edges(train, 4, len(x))
    monkeypatch.setattr(hist, "EXACT_ROWS", 100)
    many = hist.bin_edges(train, 4, len(x))
    known = x[~np.isnan(x[:, 0]), 0]
    assert np.allclose(many[0], np.quantile(known, np.arange(1, 255) / 255), rtol=1e-12)
    assert [e.tolist() for e in one] == [e.tolist() for e in many] and len(many[1]) == 40 and len(many[2]) == 1 and not len(many[3])


def whole_trees(grown, spark):
    """Of each tree the rows, feature and threshold of every node, root first, then left before right, wherever it is kept."""
    nodes = {(r["tree"], r["slot"], r["node"]): r for r in grown.nodes(spark).collect()}

    def walk(t, slot, i):
        r = nodes[t, slot, i]
        if r["feature"] < 0:
            return [(r["rows"], -1, 0.0)]
        below = [walk(t, slot, c) if c >= 0 else walk(t, -2 - c, 0) for c in (r["left"], r["right"])]
        return [(r["rows"], r["feature"], r["threshold"]), *below[0], *below[1]]

    return [walk(t, -1 if (t, -1, 0) in nodes else 0, 0) for t in range(grown.trees)]


@pytest.mark.parametrize("classes,bootstrap", [(0, False), (0, True), (3, True)])
def test_large_nodes_split_as_small_ones_do(spark, monkeypatch, classes, bootstrap):
    """Nodes too large for one task once were split on 255 bins, so trees hung on the number of rows."""
    x, y = made(14, 3000, classes)
    x = np.c_[x, np.random.default_rng(2).normal(size=3000)]
    x[:900, 1] = 0.25  # one value in several chunks
    x[np.random.default_rng(3).random(3000) < 0.1, 3] = np.nan
    train, growth = frame(spark, x, np.round(y, 2)), forest.Growth(classes, 2, bootstrap, least_split=20)
    one = whole_trees(forest.fit(train, growth, new_path(spark, "forest")), spark)
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 250)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 400)
    parted = forest.fit(train, growth, new_path(spark, "forest"))
    assert parted.nodes(spark).where("slot = -1 AND feature >= 0").count() > 10
    assert whole_trees(parted, spark) == one


def test_first_levels_are_found_above_the_subtrees(spark, monkeypatch):
    x, y = made(15, 1000, 2)
    key = ["node", "feature", "threshold", "rows"]
    found = []
    for limit in (200_000, 600, 100):
        monkeypatch.setattr(forest, "SUBTREE_ROWS", limit)
        grown = forest.fit(frame(spark, x, y), forest.Growth(2), new_path(spark, "forest"))
        found.append(sorted(map(tuple, grown.first_levels(spark).select(key).collect())))
    assert len(found[0]) == 3 and found[0] == found[1] == found[2]
