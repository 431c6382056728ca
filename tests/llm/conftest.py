import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names the operators use inside
    + [T.StructField(c, T.StringType()) for c in ("size", "slot", "node", "block", "line", "digest", "row_key", "taken", "kept", "n_words", "label", "count")]
)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, near copies."""
    base = prose(1, 200)
    texts = [
        (1, base), (2, base), (3, base + " tail"), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one two"),
        (10, prose(2, 20_000)), (11, base), (11, base), (None, base), (None, None), (None, "lonely words here"), (12, "Ünï çödé 日本 語 #*$ a\x1cb"),
        (13, "same line here that is long enough\n" * 40), (14, "same line here that is long enoughs\nother"), (15, prose(3, 60) + "\n" + prose(4, 60)),
        (16, prose(3, 60) + "\n" + prose(5, 60)), (17, "x" * 5000), (11, "another text of one id"),
    ]
    rows = []
    for k, (i, t) in enumerate(texts):
        rows.append((i, t, [None, "en", "de"][k % 3], [None, "b", "a", "c"][k % 4], None if k % 5 == 0 else len(t or ""), *[str(k)] * 12))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, [(r["doc_id"], r["text"]) for r in docs.collect()]
