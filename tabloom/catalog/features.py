"""Queries over column transforms: text, imputation, outliers, encoding, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import q
from ..functions.dates import DATE_PARTS
from ..plans.prepare import content_id
from ..operators import encode as en, impute as im, outliers as ou, textfeat as tf
from .fixtures import (
    messy, rounded, split, table, train_rows, union_all, whole, with_messy, with_split,
)
from .registry import check

# -- text -----------------------------------------------------------------------------------------

_TEXTS = {
    "code": "code", "odate": "odate", "prio": "prio", "near_const": "near_const",
    "shop_num": "CAST(shop AS VARCHAR(10))",
}


def _texts(spark, sf_dir):
    return split(spark, sf_dir).selectExpr("_split", *[f"{e} AS {c}" for c, e in _TEXTS.items()])


@check(
    "text_kind",
    with_split(
        union_all(
            [
                f"""SELECT '{c}' AS "column", round(numeric_share, 6) AS numeric_share,
        CASE WHEN numeric_share > 0.5 THEN 'numeric_text' WHEN date_share > 0.8 THEN 'date' ELSE 'text' END AS kind
        FROM (SELECT count(TRY_CAST({e} AS DOUBLE)) / CAST(count(*) AS DOUBLE) AS numeric_share,
        count(try_strptime({e}, '%Y-%m-%d')) / CAST(count(*) AS DOUBLE) AS date_share FROM t) x"""
                for c, e in _TEXTS.items()
            ]
        )
    ),
)
def text_kind(spark, sf_dir):
    found = tf.text_kind_table(train_rows(_texts(spark, sf_dir)), list(_TEXTS))
    return rounded(found.select("column", "numeric_share", "kind"), 6, "numeric_share")


def _parts_sql(source: str, c: str) -> str:
    return f"""CAST(coalesce(year({source}), -1) AS BIGINT) AS "{c}_Year", CAST(coalesce(month({source}), -1) AS BIGINT) AS "{c}_Month",
        CAST(coalesce(day({source}), -1) AS BIGINT) AS "{c}_Day", CAST(coalesce(isodow({source}) - 1, -1) AS BIGINT) AS "{c}_DayOfWeek",
        CAST(coalesce(CASE WHEN isodow({source}) >= 6 THEN 1 ELSE 0 END, 0) AS BIGINT) AS "{c}_Is_Weekend" """


@check(
    "date_parts",
    with_messy(f"SELECT o_orderkey, {_parts_sql('TRY_CAST(odate AS DATE)', 'odate')} FROM m"),
)
def date_parts(spark, sf_dir):
    state = tf.TextFeatures(date_formats={"odate": "yyyy-M-d"})
    out = state.transform(messy(spark, sf_dir).select("o_orderkey", "odate"))
    return whole(out.na.fill(-1), *[f"odate_{p}" for p in DATE_PARTS])


@check("date_parts_native", f"SELECT l_orderkey, l_linenumber, {_parts_sql('l_shipdate', 'l_shipdate')} FROM lineitem")
def date_parts_native(spark, sf_dir):
    state = tf.TextFeatures(time_columns=["l_shipdate"])
    out = state.transform(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"))
    return whole(out, *[f"l_shipdate_{p}" for p in DATE_PARTS])


_DELIMITED = {"code": "code", "prio": "prio", "piped": "replace(code, '/', '|')", "shop_txt": "shop_txt"}


def _delimiter_sql() -> str:
    parts = []
    for c, e in _DELIMITED.items():
        for pos, d in enumerate(tf.DELIMITERS):
            parts.append(
                f"""SELECT '{c}' AS "column", '{d}' AS delimiter, {pos} AS pos, k, n / CAST(total AS DOUBLE) AS share, k_max FROM (
            SELECT k, n, sum(n) OVER () AS total, max(k) OVER () AS k_max, row_number() OVER (ORDER BY n DESC, k) AS nth
            FROM (SELECT length({e}) - length(replace({e}, '{d}', '')) AS k, count(*) AS n FROM t
            WHERE {e} IS NOT NULL GROUP BY 1) g) x WHERE nth = 1"""
            )
    return f""", found AS ({union_all(parts)}),
        ok AS (SELECT *, k > 0 AND share > 0.9 AS good FROM found)
        SELECT "column", delimiter, CAST(k AS BIGINT) AS k, round(share, 6) AS share, CAST(k_max AS BIGINT) AS k_max,
        good AND pos = (SELECT min(pos) FROM ok o WHERE o."column" = ok."column" AND o.good) AS accepted FROM ok"""


@check("delimiter_probe", with_split(_delimiter_sql()))
def delimiter_probe(spark, sf_dir):
    df = train_rows(split(spark, sf_dir)).selectExpr(*[f"{e} AS {c}" for c, e in _DELIMITED.items()])
    return rounded(tf.delimiter_table(df, list(_DELIMITED)), 6, "share")


@check(
    "delimiter_split",
    with_messy(
        "SELECT o_orderkey, "
        + ", ".join(f"string_split(code, '/')[{i}] AS code_part_{i}" for i in (1, 2, 3))
        + ", "
        + ", ".join(f"string_split(code, '/')[{i}] AS piped_part_{i}" for i in (1, 2, 3))
        + " FROM m"
    ),
)
def delimiter_split(spark, sf_dir):
    df = messy(spark, sf_dir).selectExpr("o_orderkey", "code", "replace(code, '/', '|') AS piped")
    state = tf.fit_text_features(df, ["o_orderkey"])
    return state.transform(df)


# -- imputation -----------------------------------------------------------------------------------

_BOOL = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE shop > 18 END"


@check(
    "impute_categorical",
    with_messy(
        f"""SELECT o_orderkey, coalesce(code, 'None') AS code, coalesce(odate, 'None') AS odate,
        CASE WHEN f THEN 'True' WHEN NOT f THEN 'False' ELSE 'None' END AS far
        FROM (SELECT *, {_BOOL} AS f FROM m) x"""
    ),
)
def impute_categorical(spark, sf_dir):
    df = messy(spark, sf_dir).selectExpr("o_orderkey", "code", "odate", f"{_BOOL} AS far")
    return im.fit_imputer(df, ["o_orderkey"]).transform(df)


def _fill_sql(c: str) -> str:
    return f"""(SELECT CASE WHEN count({c}) = 0 THEN 0 WHEN count({c}) < 3 OR abs(skewness({c})) > 1
        THEN quantile_cont({c}, 0.5) ELSE avg({c}) END FROM t)"""


@check(
    "impute_numeric",
    with_split(
        f"""SELECT o_orderkey, round(coalesce(price, {_fill_sql("price")}), 4) AS price,
        round(coalesce(skewed, {_fill_sql("skewed")}), 4) AS skewed FROM s"""
    ),
)
def impute_numeric(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "_split", "price", "skewed")
    state = im.fit_imputer(train_rows(df), ["o_orderkey", "_split"])
    return rounded(state.transform(df).drop("_split"), 4, "price", "skewed")


# -- outliers -------------------------------------------------------------------------------------

_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _fence_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, q3 - q1 AS spread
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}) f"""


@check(
    "iqr_bounds",
    f"""SELECT "column", round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper
        FROM ({union_all([_fence_sql(c, 'lineitem') for c in _WIDE])}) x WHERE spread <> 0""",
)
def iqr_bounds(spark, sf_dir):
    return rounded(ou.iqr_table(table(spark, sf_dir, "lineitem"), _WIDE), 6, "lower", "upper")


@check(
    "vip_features",
    "WITH v AS ("
    + union_all([f"""SELECT '{c}' AS "column", var_samp({c}) AS variance FROM lineitem""" for c in _WIDE])
    + """) SELECT "column", round(variance, 2) AS variance,
        variance >= (SELECT quantile_cont(variance, 0.75) FROM v) AS vip FROM v""",
)
def vip_features(spark, sf_dir):
    return rounded(ou.vip_table(table(spark, sf_dir, "lineitem"), _WIDE), 2, "variance")


_NUM = ["s", "spiky", "shop"]
_SOURCE = "o_orderkey, _split, coalesce(skewed, 0) AS s, spiky, CAST(shop AS DOUBLE) AS shop"


def _fitted(spark, sf_dir):
    df = split(spark, sf_dir).selectExpr("o_orderkey", "_split", "coalesce(skewed, 0) AS s", "spiky", "CAST(shop AS DOUBLE) AS shop")
    return df, ou.fit_outliers(train_rows(df), _NUM, [])


_FENCED = f""", n AS (SELECT {_SOURCE} FROM s), nt AS (SELECT * FROM n WHERE _split = 'train'),
    b AS ({union_all([_fence_sql(c, 'nt') for c in _NUM])})"""


def _bound(c: str, side: str) -> str:
    return f"""(SELECT {side} FROM b WHERE "column" = '{c}' AND spread <> 0)"""


def _clipped(c: str) -> str:
    return f"least(greatest({c}, {_bound(c, 'lower')}), {_bound(c, 'upper')})"


@check(
    "outlier_flags",
    with_split(
        _FENCED
        + f""", v AS ({union_all([f"SELECT '{c}' AS col, var_samp({c}) AS variance FROM nt" for c in _NUM])})
        SELECT o_orderkey, CAST(s > {_bound("s", "upper")} AS BIGINT) AS "Is_Massive_s" FROM n
        WHERE (SELECT variance FROM v WHERE col = 's') >= (SELECT quantile_cont(variance, 0.75) FROM v)"""
    ),
)
def outlier_flags(spark, sf_dir):
    df, state = _fitted(spark, sf_dir)
    out = state.transform(df)
    return whole(out.select("o_orderkey", *state.flag_columns), *state.flag_columns)


@check(
    "iqr_clip",
    with_split(
        _FENCED + " SELECT o_orderkey, " + ", ".join(f"round({_clipped(c)}, 4) + 0.0 AS {c}" for c in _NUM) + " FROM n"
    ),
)
def iqr_clip(spark, sf_dir):
    df, state = _fitted(spark, sf_dir)
    out = ou.Outliers(bounds=state.bounds).transform(df)
    return rounded(out.select("o_orderkey", *_NUM), 4, *_NUM)


@check(
    "log_skewed",
    with_split(
        _FENCED
        + ", c AS (SELECT o_orderkey, _split, "
        + ", ".join(f"{_clipped(c)} AS {c}" for c in _NUM)
        + " FROM n), d AS (SELECT "
        + ", ".join(f"abs(skewness({c})) > 1 AND min({c}) >= 0 AND count(DISTINCT {c}) > 1 AS log_{c}" for c in _NUM)
        + " FROM c WHERE _split = 'train') SELECT o_orderkey, "
        + ", ".join(
            f"round(CASE WHEN log_{c} THEN ln(1 + greatest({c}, 0)) ELSE {c} END, 5) + 0.0 AS {c}" for c in _NUM
        )
        + " FROM c, d"
    ),
)
def log_skewed(spark, sf_dir):
    df, state = _fitted(spark, sf_dir)
    return rounded(state.transform(df).select("o_orderkey", *_NUM), 5, *_NUM)


@check(
    "rare_fold",
    with_split(
        """, r AS (SELECT prio AS v FROM t GROUP BY 1 HAVING count(*) < 0.01 * (SELECT count(*) FROM t))
        SELECT o_orderkey, CASE WHEN prio IN (SELECT v FROM r) THEN 'Other' ELSE prio END AS prio FROM s"""
    ),
)
def rare_fold(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "_split", "prio")
    return ou.fit_outliers(train_rows(df), [], ["prio"]).transform(df).drop("_split")


_SHOPPER = "concat('u', CAST(user_id AS VARCHAR(20)))"


@check(
    "rare_fold_lookup",
    f"""WITH e AS (SELECT event_id, {_SHOPPER} AS who FROM events),
        r AS (SELECT who AS v FROM e GROUP BY 1 HAVING count(*) < 0.01 * (SELECT count(*) FROM e))
        SELECT event_id, CASE WHEN who IN (SELECT v FROM r) THEN 'Other' ELSE who END AS who FROM e""",
)
def rare_fold_lookup(spark, sf_dir):
    """Many rare values: the fold goes through a written lookup table."""
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{_SHOPPER} AS who")
    _, tables = ou.rare_values(df, ["who"], inline=0)
    return ou.Outliers(rare_lookup=tables).transform(df)


# -- encoding and scaling -------------------------------------------------------------------------


@check(
    "target_encode",
    with_split(
        """, y AS (SELECT shop_txt, CASE WHEN y_bin = 'small' THEN 1.0 ELSE 0.0 END AS y FROM t),
        g AS (SELECT avg(y) AS grand, var_pop(y) AS v FROM y),
        c AS (SELECT shop_txt, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM y GROUP BY 1),
        e AS (SELECT shop_txt, v * n / (v * n + ss / n) AS w, mean, grand FROM c, g)
        SELECT o_orderkey, round(coalesce(w * mean + (1 - w) * e.grand, g.grand), 6) AS shop_txt
        FROM s LEFT JOIN e USING (shop_txt), g"""
    ),
)
def target_encode(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "_split", "shop_txt", (F.col("y_bin") == "small").cast("double").alias("y"))
    state = en.fit_encoder(train_rows(df), [], ["shop_txt"], "y")
    return rounded(state.transform(df).select("o_orderkey", "shop_txt"), 6, "shop_txt")


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "rare1", "rare2"]


@check(
    "one_hot",
    with_split(
        "SELECT o_orderkey, "
        + ", ".join(f"""CAST(prio = '{v}' AS BIGINT) AS "prio_{v}" """ for v in _LEVELS)
        + " FROM s"
    ),
)
def one_hot(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "_split", "prio", F.col("y_imb").cast("double").alias("y"))
    state = en.fit_encoder(train_rows(df), [], ["prio"], "y")
    return whole(state.transform(df).select("o_orderkey", *[q(c) for c in state.outputs]), *state.outputs)


_CLASHING = [
    "CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'yes' ELSE 'No' END AS flag",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'b_c' ELSE 'x' END AS a",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'c' ELSE 'B_C' END AS a_b",
]


@check(
    "one_hot_collisions",
    f"""WITH d AS (SELECT o_orderkey, {", ".join(_CLASHING)} FROM orders)
    SELECT o_orderkey, CAST(flag = 'No' AS BIGINT) AS "flag_No", CAST(flag = 'Yes' AS BIGINT) AS "flag_Yes",
        CAST(flag = 'yes' AS BIGINT) AS "flag_yes~2", CAST(a = 'b_c' AS BIGINT) AS "a_b_c", CAST(a = 'x' AS BIGINT) AS "a_x",
        CAST(a_b = 'B_C' AS BIGINT) AS "a_b_B_C", CAST(a_b = 'c' AS BIGINT) AS "a_b_c~2" FROM d""",
)
def one_hot_collisions(spark, sf_dir):
    """Levels that differ in case, and columns whose level names run into each other."""
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_CLASHING, "CAST(o_custkey % 2 AS DOUBLE) AS y")
    state = en.fit_encoder(df, [], ["flag", "a", "a_b"], "y")
    return whole(state.transform(df).select("o_orderkey", *[q(c) for c in state.outputs]), *state.outputs)


@check(
    "null_shifted_ids",
    "SELECT 2 * count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)",
)
def null_shifted_ids(spark, sf_dir):
    """Rows whose values are the same but stand in other columns have identities of their own."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct()
    none = F.lit(None).cast("long")
    rows = orders.select(F.col("o_custkey").alias("a"), none.alias("b"), F.col("o_orderkey").alias("c")).unionByName(
        orders.select(none.alias("a"), F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("c"))
    )
    return rows.select(F.count_distinct(content_id(rows)).alias("n"))


@check(
    "zscore",
    with_split(
        """, st AS (SELECT avg(price_twin) AS a, stddev_samp(price_twin) AS b, avg(shop) AS c, stddev_samp(shop) AS d FROM t)
        SELECT o_orderkey, round((price_twin - a) / b, 6) + 0.0 AS price_twin, round((shop - c) / d, 6) + 0.0 AS shop FROM s, st"""
    ),
)
def zscore(spark, sf_dir):
    df = split(spark, sf_dir).select("o_orderkey", "_split", "price_twin", "shop")
    state = en.fit_scaler(train_rows(df), ["price_twin", "shop"])
    return rounded(state.transform(df).drop("_split"), 6, "price_twin", "shop")


@check(
    "zero_variance_drop",
    "SELECT l_orderkey, l_linenumber, round((l_tax - a) / b, 6) + 0.0 AS l_tax FROM lineitem, "
    "(SELECT avg(l_tax) AS a, stddev_samp(l_tax) AS b FROM lineitem) st",
)
def zero_variance_drop(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", (F.col("l_quantity") * 0 + 3).alias("flat")
    )
    return rounded(en.fit_scaler(df, ["l_tax", "flat"]).transform(df), 6, "l_tax")


@check("align_columns", with_messy("SELECT o_orderkey, spiky, 0.0E0 AS gone, CAST(shop AS DOUBLE) AS shop FROM m"))
def align_columns(spark, sf_dir):
    return en.align(messy(spark, sf_dir), ["spiky", "gone", "shop"], ["o_orderkey"])
