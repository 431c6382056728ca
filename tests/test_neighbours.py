import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbours as nb
from tabloom.operators.balance import smote
from tabloom.operators.neighbours import Index, knn, vote


def frame(spark, points, start=0):
    return spark.createDataFrame(
        [(start + i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vector array<double>"
    )


def brute(queries, base, k, same):
    out = {}
    for i, p in enumerate(queries):
        found = sorted((np.sqrt(((p - b) ** 2).sum()), j) for j, b in enumerate(base) if not (same and i == j))
        out[i] = [j for _, j in found[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["neighbour_id"])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    # a third of all rows in one tight clump, exact duplicates, the rest spread out
    return np.concatenate([rng.normal(0, 0.01, (120, 4)), rng.normal(5, 3, (220, 4)), np.full((20, 4), 1.5)])


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_knn_equals_brute_force(spark, clustered, broadcast_bytes):
    df = frame(spark, clustered).repartition(5)
    got = knn(df, df, 4, exclude_self=True, broadcast_bytes=broadcast_bytes, cell_rows=25)
    assert result(got) == brute(clustered, clustered, 4, True)


def test_knn_between_two_tables_by_cells(spark, clustered):
    queries, base = clustered[::3] + 0.05, clustered[1::3]
    got = knn(frame(spark, queries), frame(spark, base), 3, broadcast_bytes=0, cell_rows=30)
    assert result(got) == brute(queries, base, 3, False)


def test_fewer_rows_than_neighbours(spark):
    points = np.array([[0.0], [1.0], [5.0]])
    df = frame(spark, points)
    for size in (1 << 20, 0):
        got = result(knn(df, df, 7, exclude_self=True, broadcast_bytes=size, cell_rows=2))
        assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_distance_weights(spark):
    near = spark.createDataFrame(
        [(1, 1, 10, 1.0), (1, 2, 11, 3.0), (2, 1, 10, 0.0), (2, 2, 11, 0.5)],
        "query_id long, rank long, neighbour_id long, distance double",
    )
    labels = spark.createDataFrame([(10, 0.0), (11, 1.0)], "neighbour_id long, label double")
    got = {r["query_id"]: r["probability"] for r in vote(near, labels, 2, "distance").collect()}
    assert got[1] == pytest.approx([0.75, 0.25]) and got[2] == pytest.approx([1.0, 0.0])


def test_smote_points_lie_between_class_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i >= 300), [float(v) for v in rng.normal(3 * (i >= 300), 1, 3)]) for i in range(320)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    grown = smote(df, "id", "y", "v").persist()
    counts = {r["y"]: r["count"] for r in grown.groupBy("y").count().collect()}
    assert counts == {0: 300, 1: 300}
    minority = {r[0]: np.array(r[2]) for r in rows if r[1]}
    for r in grown.where("_synthetic").collect():
        a, p = minority[r["id"]], np.array(r["v"])
        others = sorted((np.linalg.norm(a - b), i) for i, b in minority.items() if i != r["id"])[:5]
        gaps = [
            np.linalg.norm(p - a) + np.linalg.norm(p - minority[i]) - np.linalg.norm(a - minority[i]) for _, i in others
        ]
        assert min(gaps) < 1e-9
    # every seed serves equally often, and the outcome does not depend on partitioning
    turns = [r["count"] for r in grown.where("_synthetic").groupBy("id").count().collect()]
    assert max(turns) - min(turns) <= 1
    again = smote(df.repartition(6), "id", "y", "v").where("_synthetic")
    key = lambda d: sorted((r["id"], tuple(r["v"])) for r in d.collect())
    assert key(again) == key(grown.where("_synthetic"))


def test_smote_refuses_tiny_classes(spark):
    df = spark.range(40).select("id", (F.col("id") < 3).cast("int").alias("y"), F.array(F.col("id").cast("double")).alias("v"))
    with pytest.raises(ValueError):
        smote(df, "id", "y", "v")


@pytest.mark.parametrize("width", [1, 3, 7, 9])
def test_index_equals_every_distance(width):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(3000, width))
    base[:900], base[900:1200] = np.round(base[:900], 1), 0.5  # near ties and copies
    ids = rng.permutation(3000) // 3  # ids that repeat
    queries, own = base[600:1300], ids[600:1300]
    for exclude in (None, own):
        r, n, d = Index.of(base, ids, 4).nearest(queries, 4, exclude)
        for i in (0, 250, 299, 300, 450, 699):
            gaps = np.sqrt(((queries[i] - base) ** 2).sum(1))
            left = [(g, j) for g, j in zip(gaps, ids) if exclude is None or j != own[i]]
            assert [(x, y) for x, y in zip(n[r == i], d[r == i])] == [(j, g) for g, j in sorted(left)[:4]]


def test_index_meets_few_rows_and_holds_small_tables(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.concatenate([rng.normal(size=(40_000, 3)), np.zeros((20_000, 3))])
    met, widest = [], []
    gaps, dense = Index._gaps, Index._dense
    monkeypatch.setattr(Index, "_gaps", lambda self, *a: met.append(gaps(self, *a)) or met[-1])
    monkeypatch.setattr(Index, "_dense", lambda self, part, *a: widest.append(len(part) * len(self.rows)) or dense(self, part, *a))
    Index.of(base, np.arange(60_000), 5).nearest(base[::30], 5)
    assert sum(d.size for _, d in met) < 2000 * 60_000 / 20  # every row met every query
    long = rng.normal(size=(9000, 12))
    Index.of(long, np.arange(9000), 5).nearest(long[:1000], 5)
    assert max(widest) <= 1 << 21  # 16 million distances were held at once


def test_other_cells_give_only_rows_within_the_bound(spark, monkeypatch):
    """Every visited cell once gave its k nearest rows, however far, and cells were ruled out by their pivots alone."""
    rng = np.random.default_rng(8)
    kind = rng.integers(0, 12, 1200)
    vectors = np.c_[np.round(rng.normal(size=1200), 2), kind, kind % 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    found, visits, search = [], [], nb._search_cells

    def watched(asked, *rest):
        out = search(asked, *rest).persist()
        visits.append(asked.count())
        found.append(out.count())
        return out

    monkeypatch.setattr(nb, "_search_cells", watched)
    got = nb.knn(df, df, 5, exclude_self=True, broadcast_bytes=0, cell_rows=40).collect()
    gaps = ((vectors[:, None] - vectors[None]) ** 2).sum(2)
    np.fill_diagonal(gaps, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(1200), gaps.shape), gaps), axis=1)[:, :5]
    assert {(r["query_id"], r["rank"]): r["neighbour_id"] for r in got} == {(i, j + 1): n for i, row in enumerate(order.tolist()) for j, n in enumerate(row)}
    assert found[1] < 2 * visits[1]  # 5 a visit before
