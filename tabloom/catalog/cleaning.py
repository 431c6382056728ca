"""Queries over sources, cleaning, profiling and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators import profile as pf, rows, split as sp, target as tg
from ..operators.encode import fit_scaler
from ..operators.impute import fit_imputer, skew_table
from ..session import new_path
from ..sources import tables as io
from .fixtures import (
    ALL_COLUMNS, INTEGER_COLUMNS, IS_TEST, TEXT_COLUMNS, messy, rounded, split, table, train_rows,
    union_all, whole, with_messy, with_split,
)
from .registry import check

# -- sources and sinks ----------------------------------------------------------------------------


@check(
    "read_csv_roundtrip",
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
       o_orderstatus, o_totalprice, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS o_orderdate,
       o_orderpriority FROM orders""",
)
def read_csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "csv")
    io.write_csv(table(spark, sf_dir, "orders"), path)
    back = io.read_csv(spark, path)
    return whole(back, "o_orderkey", "o_custkey").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")
    )


@check(
    "validate_input",
    with_messy(
        union_all(
            f"""SELECT '{c}' AS target, count(*) AS n_rows, count(*) - count({c}) AS n_target_null,
            CAST(17 AS BIGINT) AS n_cols,
            CASE WHEN count(*) - count({c}) > count(*) * 0.5 THEN 'warn_target_mostly_null' ELSE 'ok' END AS verdict
            FROM m"""
            for c in ["y_reg", "mostly_null", "price"]
        )
    ),
)
def validate_input(spark, sf_dir):
    df = messy(spark, sf_dir)
    out = None
    for c in ["y_reg", "mostly_null", "price"]:
        one = io.input_facts(df, c).withColumn("target", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


@check(
    "export_clean",
    with_split(
        """, f AS (SELECT CASE WHEN abs(skewness(price)) > 1 THEN median(price) ELSE avg(price) END AS v FROM t),
        filled AS (SELECT o_orderkey, _split, coalesce(price, v) AS price, shop, y_reg FROM s, f),
        st AS (SELECT avg(price) AS pm, stddev_samp(price) AS ps, avg(shop) AS sm, stddev_samp(shop) AS ss
               FROM filled WHERE _split = 'train')
        SELECT o_orderkey, _split, round((price - pm) / ps, 6) + 0.0 AS price,
               round((shop - sm) / ss, 6) + 0.0 AS shop, round(y_reg, 6) AS y_reg FROM filled, st"""
    ),
)
def export_clean(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "_split", "price", "shop", "y_reg")
    skip = ["o_orderkey", "_split", "y_reg"]
    df = fit_imputer(train_rows(df), skip).transform(df)
    df = fit_scaler(train_rows(df), ["price", "shop"]).transform(df)
    path = new_path(spark, "clean")
    io.write_csv(df, path)
    return rounded(io.read_csv(spark, path, df.schema), 6, "price", "shop", "y_reg")


# -- rows -----------------------------------------------------------------------------------------

_NULLED = "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE y_reg END"


@check(
    "drop_null_target",
    with_messy(f"SELECT o_orderkey, round(y, 6) AS y FROM (SELECT o_orderkey, {_NULLED} AS y FROM m) x WHERE y IS NOT NULL"),
)
def drop_null_target(spark, sf_dir):
    df = messy(spark, sf_dir).selectExpr("o_orderkey", f"{_NULLED} AS y")
    return rounded(rows.drop_null_target(df, "y"), 6, "y")


@check("dedup_rows", "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def dedup_rows(spark, sf_dir):
    return rows.dedup_rows(
        table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    )


@check(
    "dedup_by_key",
    """SELECT event_id, user_id, event_type, value FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) x
       WHERE nth = 1""",
)
def dedup_by_key(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    first = rows.dedup_by_key(df, ["user_id", "event_type", "not_there"], ["ts", "event_id"])
    return first.select("event_id", "user_id", "event_type", "value")


@check("drop_leakage", with_messy("SELECT o_orderkey, code, prio, shop, y_bin FROM m"))
def drop_leakage(spark, sf_dir):
    df = messy(spark, sf_dir).select("o_orderkey", "code", "prio", "shop", "price_twin", "y_bin")
    return rows.drop_columns(df, ["price_twin", "not_there", "y_bin"], keep="y_bin")


@check("union_split", with_split("SELECT o_orderkey, shop, _split FROM s"))
def union_split(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "shop", "_split")
    train = train_rows(df).drop("_split")
    test = df.where(F.col("_split") == "test").select("shop", "o_orderkey")
    return rows.union_split(train, test)


# -- profile --------------------------------------------------------------------------------------

_FACTS = ", facts AS (" + union_all(
    [
        f"""SELECT {i} AS pos, '{c}' AS col, '{"text" if c in TEXT_COLUMNS else "int" if c in INTEGER_COLUMNS else "real"}' AS kind,
        CAST(sum(n) AS DOUBLE) AS rows_n, coalesce(max(CASE WHEN v IS NULL THEN n END), 0) AS null_n,
        max(n) AS top_n, count(v) AS distinct_n FROM (SELECT {c} AS v, count(*) AS n FROM m GROUP BY 1) g{i}"""
        for i, c in enumerate(ALL_COLUMNS)
    ]
) + """), ruled AS (SELECT *, CASE
  WHEN kind = 'text' AND distinct_n / rows_n > 0.70 THEN 'unique_text'
  WHEN kind = 'int' AND distinct_n = rows_n THEN 'unique_integer'
  WHEN strpos(lower(col), 'id') > 0 AND distinct_n / rows_n > 0.50 THEN 'named_id' END AS rule FROM facts)"""


@check(
    "profile_missing",
    with_messy(
        _FACTS
        + """ SELECT col AS "column", CAST(rows_n AS BIGINT) AS n_rows, CAST(null_n AS BIGINT) AS n_null,
        round(null_n / rows_n, 6) AS null_ratio, null_n / rows_n > 0.5 AS dropped FROM ruled"""
    ),
)
def profile_missing(spark, sf_dir):
    return rounded(pf.missing_table(messy(spark, sf_dir)), 6, "null_ratio")


@check(
    "profile_near_constant",
    with_messy(_FACTS + """ SELECT col AS "column" FROM ruled WHERE top_n / rows_n > 0.99"""),
)
def profile_near_constant(spark, sf_dir):
    found = pf.near_constant_columns(messy(spark, sf_dir), ALL_COLUMNS)
    return spark.createDataFrame([(c,) for c in found], "column string")


@check("profile_id_like", with_messy(_FACTS + """ SELECT col AS "column", coalesce(rule, 'keep') AS rule FROM ruled"""))
def profile_id_like(spark, sf_dir):
    found = pf.id_like_table(messy(spark, sf_dir))
    return found.withColumn("rule", F.coalesce("rule", F.lit("keep")))


@check(
    "detect_task",
    with_messy(
        _FACTS
        + """ SELECT col AS "column", CASE WHEN kind = 'text' OR distinct_n <= 20 THEN 'classification'
        ELSE 'regression' END AS task FROM ruled"""
    ),
)
def detect_task(spark, sf_dir):
    return tg.task_table(messy(spark, sf_dir), ALL_COLUMNS)


_TRIM_TARGET = ["y_cls", "y_imb", "y_bin"]


@check(
    "trim_table",
    with_messy(
        """SELECT round(price, 4) AS price, code, odate, prio, round(skewed, 4) AS skewed, spiky, shop, shop_txt,
        round(y_reg, 6) AS y_reg FROM m"""
    ),
)
def trim_table(spark, sf_dir):
    df = messy(spark, sf_dir).drop(*_TRIM_TARGET)
    doubled = df.unionByName(df)
    out, _ = pf.trim(doubled, "y_reg", key_cols=["o_orderkey"], leakage_cols=["price_twin"])
    return rounded(rounded(out, 4, "price", "skewed"), 6, "y_reg")


@check(
    "decision_log",
    with_messy(
        _FACTS
        + """, gone AS (SELECT *, CASE WHEN null_n / rows_n > 0.5 THEN 'high_missing'
             WHEN top_n / rows_n > 0.99 THEN 'near_constant' WHEN rule IS NOT NULL THEN 'id_like'
             WHEN col = 'price_twin' THEN 'leakage' END AS action FROM ruled
             WHERE col NOT IN ('y_cls', 'y_imb', 'y_bin', 'y_reg'))
        SELECT 'trim' AS phase, action, col AS "column", CAST(NULL AS VARCHAR) AS value FROM gone WHERE action IS NOT NULL
        UNION ALL SELECT 'trim', 'duplicates_removed', NULL, CAST(count(*) AS VARCHAR) FROM m"""
    ),
)
def decision_log(spark, sf_dir):
    df = messy(spark, sf_dir).drop(*_TRIM_TARGET)
    _, report = pf.trim(df.unionByName(df), "y_reg", leakage_cols=["price_twin"])
    return spark.createDataFrame(pf.trim_log(report), "phase string, action string, column string, value string")


# -- target ---------------------------------------------------------------------------------------

_CLASS_TARGETS = [("m", "y_cls"), ("m", "y_imb"), ("m", "y_bin"), ("labels", "quality"), ("labels", "toxic")]


@check(
    "recommend_metric_cls",
    with_messy(
        union_all(
            [
                f"""SELECT '{c}' AS target, count(*) AS n_classes, round(max(n) / CAST(min(n) AS DOUBLE), 2) AS imbalance_ratio,
        CASE WHEN max(n) / CAST(min(n) AS DOUBLE) < 3 THEN 'accuracy' ELSE 'f1_weighted' END AS primary_metric,
        CASE WHEN max(n) / CAST(min(n) AS DOUBLE) < 3 THEN 'balanced' WHEN max(n) / CAST(min(n) AS DOUBLE) <= 10
        THEN 'moderate' ELSE 'severe' END AS balance, max(n) / CAST(min(n) AS DOUBLE) >= 3 AS use_class_weight
        FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1) g"""
                for t, c in _CLASS_TARGETS
            ]
        )
    ),
)
def recommend_metric_cls(spark, sf_dir):
    frames = {"m": messy(spark, sf_dir), "labels": table(spark, sf_dir, "labels")}
    out = None
    for t, c in _CLASS_TARGETS:
        one = tg.class_metric(frames[t], c).withColumn("target", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


_NUMBER_TARGETS = [("events", "value"), ("orders", "o_totalprice"), ("documents", "n_chars")]


@check(
    "recommend_metric_reg",
    union_all(
        [
            f"""SELECT '{c}' AS target, round(skewness({c}), 3) AS target_skew,
        abs(skewness({c})) > 1 AS log_transform_target, 'r2' AS primary_metric FROM {t}"""
            for t, c in _NUMBER_TARGETS
        ]
    ),
)
def recommend_metric_reg(spark, sf_dir):
    out = None
    for t, c in _NUMBER_TARGETS:
        one = tg.regression_metric(table(spark, sf_dir, t), c).withColumn("target", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


@check(
    "label_map",
    """SELECT o_orderpriority AS label, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS idx
       FROM (SELECT DISTINCT o_orderpriority FROM orders) x""",
)
def label_map(spark, sf_dir):
    return tg.label_table(table(spark, sf_dir, "orders"), "o_orderpriority")


@check(
    "class_weights",
    with_messy(
        """SELECT y_cls AS label, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6) AS weight
        FROM (SELECT y_cls, count(*) AS n FROM m GROUP BY 1) g"""
    ),
)
def class_weights(spark, sf_dir):
    return rounded(tg.class_weights(messy(spark, sf_dir), "y_cls"), 6, "weight")


@check(
    "log_target_roundtrip",
    """SELECT event_id, round(ln(1 + greatest(value, 0)), 6) + 0.0 AS logged,
       round(exp(ln(1 + greatest(value, 0))) - 1, 4) + 0.0 AS back FROM events""",
)
def log_target_roundtrip(spark, sf_dir):
    logged = tg.log_target(q("value"))
    df = table(spark, sf_dir, "events").select("event_id", logged.alias("logged"), tg.unlog_target(logged).alias("back"))
    return rounded(rounded(df, 6, "logged"), 4, "back")


# -- sampling -------------------------------------------------------------------------------------


@check("train_test_split", f"SELECT o_orderkey, CASE WHEN {IS_TEST} THEN 'test' ELSE 'train' END AS _split FROM orders")
def train_test_split(spark, sf_dir):
    return sp.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "_split")


_HASH = "md5(concat('42:', CAST({} AS VARCHAR)))"


@check(
    "stratified_sample",
    with_messy(
        f"""SELECT o_orderkey, y_imb FROM (SELECT o_orderkey, y_imb,
        row_number() OVER (PARTITION BY y_imb ORDER BY {_HASH.format("o_orderkey")}) AS nth,
        round_even(1000.0 * count(*) OVER (PARTITION BY y_imb) / count(*) OVER (), 0) AS quota FROM m) x
        WHERE nth <= quota"""
    ),
)
def stratified_sample(spark, sf_dir):
    df = messy(spark, sf_dir).select("o_orderkey", "y_imb")
    return sp.stratified_sample(df, "o_orderkey", "y_imb", 1000)


@check(
    "simple_sample",
    f"SELECT event_id, user_id, event_type FROM events ORDER BY {_HASH.format('event_id')} LIMIT 700",
)
def simple_sample(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sp.simple_sample(df, "event_id", 700)


@check(
    "cv_folds",
    with_messy(
        f"""SELECT o_orderkey, y_imb, CAST((row_number() OVER (PARTITION BY y_imb
        ORDER BY {_HASH.format("o_orderkey")}) - 1) % 5 AS BIGINT) AS _fold FROM m"""
    ),
)
def cv_folds(spark, sf_dir):
    df = messy(spark, sf_dir).select("o_orderkey", "y_imb")
    return whole(sp.with_folds(df, "o_orderkey", 5, "y_imb"), "_fold")


_SKEWED = ["price", "skewed", "spiky", "shop", "price_twin"]


@check(
    "skew_profile",
    with_split(
        union_all(
            [
                f"""SELECT '{c}' AS "column", count({c}) AS n, round(skewness({c}), 5) AS skew FROM t"""
                for c in _SKEWED
            ]
        )
    ),
)
def skew_profile(spark, sf_dir):
    return rounded(skew_table(train_rows(split(spark, sf_dir)), _SKEWED), 5, "skew")
