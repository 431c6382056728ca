"""Queries over metrics, leaderboards, stop rules and votes.

The "models" here are simple rules over the orders whose scores SQL can reproduce.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as ev
from .fixtures import messy, rounded, split, union_all, whole, with_messy, with_split
from .registry import check

_PRED = "CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE y_cls END"
_SCORED = f", p AS (SELECT y_cls AS label, {_PRED} AS prediction FROM m)"
_PER_CLASS = (
    _SCORED
    + """, c AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
    k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS hits,
      (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE prediction = c) AS chosen FROM c),
    f AS (SELECT c, support, hits, coalesce(hits / nullif(CAST(chosen AS DOUBLE), 0), 0) AS pr,
      coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0) AS re,
      coalesce(2 * hits / nullif(CAST(support + chosen AS DOUBLE), 0), 0) AS f1 FROM k)"""
)


def _scored(spark, sf_dir):
    return messy(spark, sf_dir).selectExpr("y_cls AS label", f"{_PRED} AS prediction")


@check(
    "eval_classification",
    with_messy(
        _PER_CLASS
        + " SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f"
    ),
)
def eval_classification(spark, sf_dir):
    out = ev.classification_metrics(_scored(spark, sf_dir), "label", "prediction")
    return rounded(out, 6, "accuracy", "f1_weighted")


def _line(name: str, expr: str) -> str:
    cells = ", ".join(f"round({expr.format(x)}, 6) AS {n}" for x, n in (("pr", "precision"), ("re", "recall"), ("f1", "f1")))
    return f"SELECT '{name}' AS class, {cells}, CAST(sum(support) AS BIGINT) AS support FROM f"


@check(
    "classification_report",
    with_messy(
        _PER_CLASS
        + " SELECT c AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f UNION ALL "
        + union_all(
            [
                _line("macro avg", "avg({})"),
                _line("weighted avg", "sum({} * support) / sum(support)"),
                "SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), "
                "round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f",
            ]
        )
    ),
)
def classification_report(spark, sf_dir):
    out = ev.classification_report(_scored(spark, sf_dir), "label", "prediction")
    return rounded(out, 6, "precision", "recall", "f1")


@check(
    "eval_regression",
    with_messy(
        """, p AS (SELECT y_reg AS y, price_twin / 2000 + 20 AS p FROM m)
        SELECT round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
        round(sqrt(avg(pow(y - p, 2))), 6) AS rmse FROM p"""
    ),
)
def eval_regression(spark, sf_dir):
    df = messy(spark, sf_dir).selectExpr("y_reg AS y", "price_twin / 2000 + 20 AS p")
    return rounded(ev.regression_metrics(df, "y", "p"), 6, "r2", "mae", "rmse")


# rules that guess y_bin; the third is the leak itself
_RULES = {
    "cautious": "CASE WHEN price > 300000 THEN 'big' ELSE 'small' END",
    "bold": "CASE WHEN price > 210000 THEN 'big' ELSE 'small' END",
    "parity": "CASE WHEN shop % 2 = 0 THEN 'big' ELSE 'small' END",
    "twin": "CASE WHEN price_twin > 500250 THEN 'big' ELSE 'small' END",
    "balanced": "CASE WHEN price > 250000 THEN 'big' ELSE 'small' END",
}


def _accuracies(source: str, rules: dict[str, str]) -> str:
    """(model, score, status) of the rules by SQL."""
    return union_all(
        [
            f"SELECT '{n}' AS model, avg(CASE WHEN {r} = y_bin THEN 1.0E0 ELSE 0.0E0 END) AS score, 'ok' AS status FROM {source}"
            for n, r in rules.items()
        ]
    )


def _scores(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(model, score, status) of the rules, each evaluated over the whole table."""
    parts = [
        ev.classification_metrics(df.selectExpr("y_bin", f"{r} AS prediction"), "y_bin", "prediction").select(
            F.lit(n).alias("model"), F.col("accuracy").alias("score"), F.lit("ok").alias("status")
        )
        for n, r in rules.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@check(
    "leaderboard",
    with_messy(
        f", b AS ({_accuracies('m', _RULES)}) SELECT row_number() OVER (ORDER BY score DESC, model) AS rank, model, round(score, 4) AS score FROM b"
    ),
)
def leaderboard(spark, sf_dir):
    return ev.leaderboard(_scores(messy(spark, sf_dir), _RULES))


@check(
    "top_models",
    with_messy(
        f", b AS ({_accuracies('m', _RULES)}), r AS (SELECT row_number() OVER (ORDER BY score DESC, model) AS rank, model, round(score, 4) AS score FROM b) SELECT * FROM r WHERE rank <= 3"
    ),
)
def top_models(spark, sf_dir):
    return ev.top_models(_scores(messy(spark, sf_dir), _RULES), 3)


@check(
    "stop_rules",
    with_messy(
        f""", b AS ({_accuracies('m', _RULES)}) SELECT round(max(score), 6) AS best, CASE WHEN max(score) <= 0.05 THEN 'no_signal'
        WHEN max(score) >= 0.9999 THEN 'leakage' ELSE 'continue' END AS verdict FROM b"""
    ),
)
def stop_rules(spark, sf_dir):
    return rounded(ev.stop_rules(_scores(messy(spark, sf_dir), _RULES)), 6, "best")


_TUNED = {n: r.replace("300000", "260000").replace("210000", "190000") for n, r in _RULES.items()}


@check(
    "tuning_accept",
    with_messy(
        f""", b AS ({_accuracies('m', _RULES)}), u AS ({_accuracies('m', _TUNED)})
        SELECT b.model, round(b.score, 6) AS baseline, round(u.score, 6) AS tuned, round(u.score, 4) > round(b.score, 4) AS improved,
        round(CASE WHEN round(u.score, 4) > round(b.score, 4) THEN u.score ELSE b.score END, 6) AS kept FROM b JOIN u USING (model)"""
    ),
)
def tuning_accept(spark, sf_dir):
    df = messy(spark, sf_dir)
    base = _scores(df, _RULES).select("model", F.col("score").alias("baseline"))
    tuned = _scores(df, _TUNED).select("model", F.col("score").alias("tuned"))
    return rounded(ev.accept_tuning(base.join(tuned, "model")), 6, "baseline", "tuned", "kept")


@check(
    "final_choice",
    with_messy(
        f""", a AS (SELECT 'baseline' AS stage, 0 AS o, * FROM ({_accuracies('m', _RULES)}) x
        UNION ALL SELECT 'tuned', 1, * FROM ({_accuracies('m', _TUNED)}) z)
        SELECT stage, model, round(score, 6) AS score FROM a ORDER BY score DESC, o, model LIMIT 1"""
    ),
)
def final_choice(spark, sf_dir):
    df = messy(spark, sf_dir)
    stages = [_scores(df, r).withColumn("stage", F.lit(s)) for s, r in (("baseline", _RULES), ("tuned", _TUNED))]
    return rounded(ev.final_choice(reduce(DataFrame.unionByName, stages)), 6, "score")


_P1 = "least(greatest((price_twin - 1000) / 999983, 0.0E0), 1.0E0)"
_P2 = "CASE WHEN shop % 2 = 0 THEN 0.7E0 ELSE 0.2E0 END"


@check(
    "soft_vote",
    with_split(
        f"""SELECT o_orderkey, round((1 - a + 1 - b) / 2, 5) AS p0, round((a + b) / 2, 5) AS p1,
        CAST(CASE WHEN (a + b) / 2 > (1 - a + 1 - b) / 2 THEN 1 ELSE 0 END AS BIGINT) AS prediction
        FROM (SELECT o_orderkey, {_P1} AS a, {_P2} AS b FROM s) x"""
    ),
)
def soft_vote(spark, sf_dir):
    df = split(spark, sf_dir).selectExpr("o_orderkey", f"{_P1} AS a", f"{_P2} AS b")
    df = df.select("o_orderkey", *[F.array(1 - F.col(c), F.col(c)).alias(c) for c in ("a", "b")])
    out = ev.soft_vote(df, ["a", "b"])
    p = F.col("prediction_probability")
    out = out.select("o_orderkey", p[0].alias("p0"), p[1].alias("p1"), "prediction")
    return whole(rounded(out, 5, "p0", "p1"), "prediction")


@check(
    "mean_vote",
    with_messy("SELECT o_orderkey, round((price_twin / 2000 + y_reg + shop) / 3, 5) AS prediction FROM m"),
)
def mean_vote(spark, sf_dir):
    df = messy(spark, sf_dir).selectExpr("o_orderkey", "price_twin / 2000 AS a", "y_reg AS b", "CAST(shop AS DOUBLE) AS c")
    return rounded(ev.mean_vote(df, ["a", "b", "c"]).select("o_orderkey", "prediction"), 5, "prediction")
