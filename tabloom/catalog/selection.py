"""Queries over statistical selection, importances, balancing and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators import importance as imp, select as sel
from ..operators.balance import smote
from ..operators.neighbours import knn, vote
from ..operators.outliers import vip_table
from ..operators.split import is_test
from .fixtures import messy, rounded, table, union_all, whole, with_messy
from .models import frames
from .registry import check

# -- correlation ----------------------------------------------------------------------------------

_LINES = """SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
  l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
  l_quantity * l_extendedprice AS volume, CASE WHEN l_linestatus = 'O' THEN 1.0E0 ELSE 0.0E0 END AS y FROM lineitem"""
_COLS = ["qty", "price", "disc", "tax", "net", "gross", "volume"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


def _lines(spark, sf_dir):
    return spark.sql(_LINES.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf_dir, "lineitem"))


_WITH_R = (
    f"WITH l AS ({_LINES}), r AS ("
    + union_all([f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM l" for a, b in _PAIRS])
    + "), y AS ("
    + union_all([f"SELECT '{c}' AS c, abs(corr({c}, y)) AS r FROM l" for c in _COLS])
    + ") "
)


@check("corr_matrix", _WITH_R + "SELECT a AS col_i, b AS col_j, round(r, 5) AS abs_r FROM r")
def corr_matrix(spark, sf_dir):
    return rounded(sel.correlation_table(_lines(spark, sf_dir), _COLS), 5, "abs_r")


@check("corr_target", _WITH_R + """SELECT c AS "column", round(r, 5) AS abs_r FROM y""")
def corr_target(spark, sf_dir):
    return rounded(sel.target_correlation_table(_lines(spark, sf_dir), _COLS, "y"), 5, "abs_r")


@check(
    "multicollinear_drop",
    _WITH_R
    + """SELECT DISTINCT CASE WHEN ya.r < yb.r THEN a ELSE b END AS dropped
    FROM r JOIN y ya ON ya.c = a JOIN y yb ON yb.c = b WHERE r.r > 0.80""",
)
def multicollinear_drop(spark, sf_dir):
    dropped = sel.multicollinear_columns(_lines(spark, sf_dir), _COLS, "y")
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


# -- categories -----------------------------------------------------------------------------------

_CATS = ["prio", "shop_txt", "code3"]
_TABLE = """, k AS (SELECT coalesce(prio, 'None') AS prio, shop_txt, coalesce(code, 'None') AS code3, y_cls, y_bin,
    CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, y_reg FROM m)"""


def _cats(spark, sf_dir):
    return messy(spark, sf_dir).selectExpr(
        "coalesce(prio, 'None') AS prio", "shop_txt", "coalesce(code, 'None') AS code3", "y_cls", "y_bin",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity", "y_reg",
    )


def _chi2_sql(c: str, y: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN max(rows_n) = 2 AND max(cols_n) = 2
        THEN sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) ELSE sum(pow(o - e, 2) / e) END AS statistic,
        (max(rows_n) - 1) * (max(cols_n) - 1) AS dof FROM (
        SELECT rt.n * ct.n / CAST(sum(rt.n) OVER (PARTITION BY ct.y) AS DOUBLE) AS e, coalesce(x.n, 0) AS o,
        (SELECT count(DISTINCT {c}) FROM k) AS rows_n, (SELECT count(DISTINCT {y}) FROM k) AS cols_n
        FROM (SELECT {c} AS v, count(*) AS n FROM k GROUP BY 1) rt
        CROSS JOIN (SELECT {y} AS y, count(*) AS n FROM k GROUP BY 1) ct
        LEFT JOIN (SELECT {c} AS v, {y} AS y, count(*) AS n FROM k GROUP BY 1, 2) x ON x.v = rt.v AND x.y = ct.y) z"""


@check(
    "chi2_select",
    with_messy(
        _TABLE
        + """ SELECT "column", round(statistic, 4) + 0.0 AS statistic, CAST(dof AS BIGINT) AS dof FROM ("""
        + union_all([*[_chi2_sql(c, "y_cls") for c in _CATS], _chi2_sql("parity", "y_bin")])
        + ") u"
    ),
)
def chi2_select(spark, sf_dir):
    df = _cats(spark, sf_dir)
    wide = sel.chi2_table(df, _CATS, "y_cls")
    square = sel.chi2_table(df, ["parity"], "y_bin")
    out = wide.unionByName(square).select("column", "statistic", "dof")
    return whole(rounded(out, 4, "statistic"), "dof")


@check(
    "anova_select",
    with_messy(
        _TABLE
        + union_all(
            [
                f""" SELECT '{c}' AS "column", round((sum(n * pow(mean - grand, 2)) / (count(*) - 1))
        / (sum(ss) / (sum(n) - count(*))), 4) AS statistic, count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2
        FROM (SELECT count(*) AS n, avg(y_reg) AS mean, var_pop(y_reg) * count(*) AS ss FROM k GROUP BY {c}) g,
        (SELECT avg(y_reg) AS grand FROM k) o"""
                for c in _CATS
            ]
        )
    ),
)
def anova_select(spark, sf_dir):
    return rounded(sel.anova_table(_cats(spark, sf_dir), _CATS, "y_reg"), 4, "statistic")


_LINE_CATS = ["l_returnflag", "l_linestatus"]


@check(
    "category_freq",
    union_all(
        [
            f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
        round(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 6) AS share FROM lineitem GROUP BY {c}"""
            for c in _LINE_CATS
        ]
    ),
)
def category_freq(spark, sf_dir):
    return rounded(sel.category_frequencies(table(spark, sf_dir, "lineitem"), _LINE_CATS), 6, "share")


@check(
    "crosstab",
    union_all(
        [
            f"""SELECT '{c}' AS "column", {c} AS value, lang AS label, count(*) AS n FROM documents GROUP BY {c}, lang"""
            for c in ["source"]
        ]
    ),
)
def crosstab(spark, sf_dir):
    return sel.crosstab(table(spark, sf_dir, "documents"), ["source"], "lang")


# -- importances ----------------------------------------------------------------------------------


@check(
    "elbow_cut",
    f"WITH l AS ({_LINES}), v AS ("
    + union_all([f"SELECT '{c}' AS feature, ln(1 + var_samp({c})) AS importance FROM l" for c in _COLS])
    + """), o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
      sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS reach,
      (row_number() OVER (ORDER BY importance DESC, feature) - 1) / (count(*) OVER () - 1.0E0)
      + (importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER ()) AS bend FROM v)
    SELECT rank, feature, round(importance, 5) AS importance,
      rank <= greatest((SELECT rank FROM o ORDER BY round(bend, 12), rank LIMIT 1), (SELECT min(rank) FROM o WHERE reach >= 0.95)) AS kept
    FROM o""",
)
def elbow_cut(spark, sf_dir):
    """The cut over data-derived importances: log variances of the line columns."""
    spread = vip_table(_lines(spark, sf_dir), _COLS)
    importances = spread.select(q("column").alias("feature"), F.log1p("variance").alias("importance"))
    return rounded(imp.elbow_table(importances), 5, "importance")


@check(
    "rf_importance",
    union_all([f"SELECT '{f}' AS feature, TRUE AS in_range, TRUE AS sums_to_one, {'TRUE' if f == 'price' else 'FALSE'} AS first" for f in ("price", "spiky", "shop", "skewed")]),
)
def rf_importance(spark, sf_dir):
    """Importances of a forest of 100 trees; the price alone tells big orders from small ones."""
    data = frames(spark, sf_dir, "y_bin")
    table_ = imp.elbow_table(imp.forest_importances(data.train, data.features, data.n_classes))
    total = table_.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))
    return table_.select("feature", q("importance").between(0, 1).alias("in_range"), (F.col("rank") == 1).alias("first")).crossJoin(total)  # one row


# -- neighbours and balancing ---------------------------------------------------------------------

_DISTANCE = """sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))))"""


@check(
    "knn_topk",
    f"""SELECT query_id, CAST(nth AS BIGINT) AS rank, neighbour_id, round(d, 4) AS distance FROM (
        SELECT query_id, neighbour_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS nth FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {_DISTANCE} AS d
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) p) x WHERE nth <= 5""",
)
def knn_topk(spark, sf_dir):
    """The five nearest other rows of every row."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(knn(rows, rows, 5, "vec_id", "embedding", exclude_self=True), 4, "distance")


_VEC_TEST = "substr(md5(concat('42:', CAST({}.vec_id AS VARCHAR))), 1, 4) < '3333'"


@check(
    "knn_classify",
    f"""WITH near AS (SELECT query_id, label FROM (SELECT query_id, label,
        row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS nth FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label, {_DISTANCE} AS d
        FROM embeddings a, embeddings b WHERE {_VEC_TEST.format("a")} AND NOT {_VEC_TEST.format("b")}) p) x WHERE nth <= 5)
        SELECT query_id AS vec_id, CAST(label AS BIGINT) AS prediction, round(n / 5.0, 4) AS share FROM (
        SELECT query_id, label, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS nth
        FROM (SELECT query_id, label, count(*) AS n FROM near GROUP BY 1, 2) g) y WHERE nth = 1""",
)
def knn_classify(spark, sf_dir):
    """Test rows of the split voted on by their five nearest training rows."""
    rows = table(spark, sf_dir, "embeddings").withColumn("_test", is_test(q("vec_id"), 0.2, 42))
    train = rows.where(~q("_test"))
    near = knn(rows.where("_test"), train, 5, "vec_id", "embedding")
    votes = vote(near, train.select(q("vec_id").alias("neighbour_id"), "label"), 10)
    share = F.array_max("probability")
    return votes.select(
        q("query_id").alias("vec_id"),
        (F.array_position("probability", share) - 1).cast("long").alias("prediction"),
        F.round(share, 4).alias("share"),
    )


_POINT = "price_twin, spiky, CAST(shop AS DOUBLE) AS shop"


def _points(spark, sf_dir):
    return messy(spark, sf_dir).selectExpr(
        "o_orderkey", "y_imb", "array(price_twin / 1000, spiky, CAST(shop AS DOUBLE)) AS v"
    )


@check(
    "smote_counts",
    with_messy(
        """, c AS (SELECT y_imb, count(*) AS n FROM m GROUP BY 1)
        SELECT y_imb, CAST((SELECT max(n) FROM c) AS BIGINT) AS n, CAST((SELECT max(n) FROM c) - n AS BIGINT) AS made FROM c"""
    ),
)
def smote_counts(spark, sf_dir):
    grown = smote(_points(spark, sf_dir), "o_orderkey", "y_imb", "v")
    return grown.groupBy("y_imb").agg(F.count("*").alias("n"), F.count_if("_synthetic").alias("made"))


@check(
    "smote_neighbours",
    with_messy(
        """, p AS (SELECT o_orderkey AS id, price_twin / 1000 AS a, spiky AS b, CAST(shop AS DOUBLE) AS c FROM m WHERE y_imb = 1)
        SELECT query_id, CAST(nth AS BIGINT) AS rank, neighbour_id, round(d, 4) AS distance FROM (
        SELECT query_id, neighbour_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS nth FROM (
        SELECT l.id AS query_id, r.id AS neighbour_id, sqrt(pow(l.a - r.a, 2) + pow(l.b - r.b, 2) + pow(l.c - r.c, 2)) AS d
        FROM p l JOIN p r ON l.id <> r.id) j) x WHERE nth <= 5"""
    ),
)
def smote_neighbours(spark, sf_dir):
    minority = _points(spark, sf_dir).where("y_imb = 1")
    return rounded(knn(minority, minority, 5, "o_orderkey", "v", exclude_self=True), 4, "distance")


@check(
    "smote_points",
    with_messy("""SELECT CAST(sum(CASE y_imb WHEN 0 THEN 1 ELSE -1 END) AS BIGINT) AS n, CAST(sum(CASE y_imb WHEN 0 THEN 1 ELSE -1 END) AS BIGINT) AS n_on_segment,
        CAST(sum(y_imb) AS BIGINT) AS seeds, TRUE AS even FROM m"""),
)
def smote_points(spark, sf_dir):
    """Synthetic rows: how many lie between their seed and one of its five nearest rows of the class, and how evenly seeds serve."""
    points = _points(spark, sf_dir)
    made = smote(points, "o_orderkey", "y_imb", "v").where("_synthetic")
    rows = points.where("y_imb = 1").select(q("o_orderkey").alias("id"), q("v").cast("array<double>").alias("vector"))
    near = knn(rows, rows, 5, exclude_self=True).select(q("query_id").alias("o_orderkey"), "neighbour_id")
    ends = near.join(rows.select(q("id").alias("neighbour_id"), q("vector").alias("b")), "neighbour_id")
    ends = ends.join(rows.select(q("id").alias("o_orderkey"), q("vector").alias("a")), "o_orderkey")
    numbered = made.withColumn("_n", F.monotonically_increasing_id())

    def gap(x, y):
        return F.sqrt(F.aggregate(F.zip_with(x, y, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))

    p = q("v").cast("array<double>")
    off = F.min(gap(p, q("a")) + gap(p, q("b")) - gap(q("a"), q("b"))).alias("off")
    judged = numbered.join(ends, "o_orderkey").groupBy("_n", "o_orderkey").agg(off, F.max(gap(q("a"), q("b"))).alias("span"))
    turns = judged.groupBy("o_orderkey").agg(F.count("*").alias("turns"), F.count_if(q("off") <= 1e-7 * (1 + q("span"))).alias("good"))
    return turns.agg(
        F.sum("turns").alias("n"), F.sum("good").alias("n_on_segment"), F.count("*").alias("seeds"), (F.max("turns") - F.min("turns") <= 1).alias("even")
    )
