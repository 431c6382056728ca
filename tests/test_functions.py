import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import quantiles as qn
from tabloom.functions.dates import DATE_FORMATS, parsed, shape
from tabloom.functions.hashing import hash_rank, seeded_md5
from tabloom.functions.moments import adjusted_skew
from tabloom.functions.pvalues import chi2_p_value, f_p_value
from tabloom.operators.split import train_test_split, with_folds


@pytest.mark.parametrize(
    "x, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01), (124.342113, 100, 0.05)]
)
def test_chi2_critical_values(x, dof, p):
    assert chi2_p_value(x, dof) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(
    "x, d1, d2, p", [(4.964603, 1, 10, 0.05), (3.325835, 5, 10, 0.05), (10.044289, 1, 10, 0.01), (2.866081, 4, 20, 0.05)]
)
def test_f_critical_values(x, d1, d2, p):
    assert f_p_value(x, d1, d2) == pytest.approx(p, abs=1e-6)


def test_p_value_edges():
    assert f_p_value(None, 1, 2) is None and chi2_p_value(float("nan"), 1) is None
    assert f_p_value(math.inf, 1, 2) == 0.0 and chi2_p_value(0.0, 3) == 1.0
    # a large table far out in the tail stays a number
    assert 0 <= f_p_value(1.0002, 36, 1e12) <= 1


def test_adjusted_skew_matches_pandas(spark):
    values = [1.0, 2.0, 2.5, 9.0, 30.0, 31.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.agg(adjusted_skew(F.col("v"))).first()[0]
    assert got == pytest.approx(pd.Series(values).skew(), abs=1e-12)
    assert df.limit(2).agg(adjusted_skew(F.col("v"))).first()[0] is None
    assert df.agg(adjusted_skew(F.lit(3.0))).first()[0] == 0.0


def columns_of_trouble(n=6000):
    rnd = random.Random(7)
    hot = [5.0 if rnd.random() < 0.4 else rnd.gauss(5, 2) for _ in range(n)]
    return {
        "smooth": [rnd.random() * 1e6 for _ in range(n)],
        "hot": hot,
        "few": [float(rnd.randrange(3)) for _ in range(n)],
        "flat": [2.5] * n,
        "gaps": [None if i % 3 == 0 else rnd.expovariate(1e-3) for i in range(n)],
        "zero_heavy": [0.0 if i % 4 else float(i) for i in range(n)],
        "empty": [None] * n,
    }


def test_refined_quantiles_equal_numpy(spark):
    data = columns_of_trouble()
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = qn._refined(df, list(data), probabilities, fetch=40)
    for c, values in data.items():
        known = [v for v in values if v is not None]
        if known:
            assert got[c] == pytest.approx(list(np.quantile(known, probabilities)), rel=1e-12), c
        else:
            assert got[c] == [None] * len(probabilities)
    assert qn.quantiles(df, ["hot"], [0.5])["hot"] == pytest.approx([np.quantile(data["hot"], 0.5)])
    assert abs(qn.quantiles(df, ["smooth"], [0.5], approx=True)["smooth"][0] - 5e5) < 5e4


def test_hash_rank_is_a_total_order_whatever_the_partitions(spark):
    df = spark.range(5000).withColumn("hot", (F.col("id") % 10 > 2).cast("int"))
    want = {
        r["id"]: i
        for group in (0, 1)
        for i, r in enumerate(
            df.where(F.col("hot") == group).withColumn("h", seeded_md5(F.col("id"), 42)).orderBy("h").collect(), 1
        )
    }
    for parts, bucket in ((1, 100_000), (7, 50)):
        ranked = hash_rank(df.repartition(parts), "id", 42, by=["hot"], rows_per_bucket=bucket)
        assert {r["id"]: r["_rank"] for r in ranked.collect()} == want


def test_split_and_folds_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("y", F.col("id") % 7)
    a = {r["id"]: r["_split"] for r in train_test_split(df, "id").collect()}
    b = {r["id"]: r["_split"] for r in train_test_split(df.repartition(9), "id").collect()}
    assert a == b and 0.15 < sum(v == "test" for v in a.values()) / 2000 < 0.25
    sizes = with_folds(df, "id", 4, "y").groupBy("y", "_fold").count().groupBy("y").agg(F.max("count") - F.min("count"))
    assert max(r[1] for r in sizes.collect()) <= 1


def test_every_date_format_has_a_matching_shape():
    import re

    samples = {
        "yyyy-M-d": "2024-03-09", "yyyy-M-d'T'H:m[:s][.SSSSSS][.SSS][XXX]": "2024-03-09T10:11:12.123Z",
        "MMM d, yyyy": "Mar 9, 2024", "d.M.yyyy": "9.3.2024",
    }
    for fmt, text in samples.items():
        assert fmt in DATE_FORMATS and re.match(shape(fmt), text)
    assert not re.match(shape("d.M.yyyy"), "9-3-2024")


@pytest.mark.parametrize(
    "text, day",
    [
        ("1/2/24", "2024-01-02"), ("01/02/2024 03:04 PM", "2024-01-02"), ("January 5, 2024", "2024-01-05"), ("5 March 2024", "2024-03-05"),
        ("2024-01-05 10:00:00+00:00", "2024-01-05"), ("2024-01-05 10:00:00 +02:00", "2024-01-05"), ("2024-1-5 1:00 am", "2024-01-05"),
    ],
)
def test_common_date_texts(spark, text, day):
    from tabloom.operators.textfeat import text_kind_table

    df = spark.createDataFrame([(text,)] * 3, "d string")
    found = text_kind_table(df, ["d"]).first()
    assert found["kind"] == "date" and found["date_share"] == 1.0
    assert str(df.select(parsed(F.col("d"), found["date_format"]).cast("date")).first()[0]) == day
