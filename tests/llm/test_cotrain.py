"""Co-training against a plain version of the same rounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import cotrain
from tabloom.llm.common import Scratch


def table(spark, n=700, nulls=False):
    """Words and the source tell both labels, with noise; two thirds are labelled."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(20, 60))]
        w += (["junk"] * 2 if bad and rng.random() < 0.9 else []) + (["rude"] if toxic and rng.random() < 0.9 else [])
        rng.shuffle(w)
        source = ("low" if bad else "high") if rng.random() < 0.9 else "other"
        source += "-t" if toxic and rng.random() < 0.8 else ""
        gone = nulls and i % 9 == 0
        rows.append((i, " ".join(w), None if gone else "en", None if gone else source, None if gone else len(w)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def keyed(docs):
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("same"), "doc_id", "text", "source", "lang", "n_chars")


def plain_fit(x, y, penalty):
    """Proximal steps on a dense matrix until nothing moves."""
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    z = np.c_[x, np.ones(len(x))]
    rate = 4 / np.linalg.eigvalsh((z.T * share) @ z)[-1]
    w = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(6000):
        new = ahead - rate * z.T @ (share * (1 / (1 + np.exp(-z @ ahead)) - y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        if (ahead - new) @ (new - w) > 0:
            t, ahead, w = 1.0, w, new
            continue
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def plain_calibration(m, y):
    x = np.c_[m, np.ones(len(y))]
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        w = w - 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + np.r_[np.full(x.shape[1] - 1, 1e-3), 0] * w)
    return w


def test_rounds_equal_a_plain_version(spark):
    rows, labels, docs, label_table = table(spark, 420)
    named = keyed(docs)
    heads, handed = cotrain.co_train(named, label_table, Scratch(spark), rounds=1, steps=6000)
    key = {r["doc_id"]: r["key"] for r in named.collect()}
    aside = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(cotrain.CALIBRATION)) == 0).select("doc_id").collect()}
    features = cotrain.Features()
    found = {r[0]: dict(zip(cotrain.VIEWS, (set(p.tolist()) for p in features(r[1], r[3], r[2], r[4])))) for r in rows}
    known = {i: dict(zip(cotrain.HEADS, v)) for i, *v in labels}
    pool = [r[0] for r in rows if r[0] not in known]
    names, count = {k: i for i, k in key.items()}, 0
    for head in cotrain.HEADS:
        fit, check = ([i for i in known if (i in aside) == side] for side in (False, True))
        y = np.array([known[i][head] for i in fit], dtype=float)
        used = set()
        for view, other in (("text", "meta"), ("meta", "text")):
            places = sorted({p for i in found for p in found[i][view]})
            at = {p: k for k, p in enumerate(places)}
            matrix = np.zeros((len(rows), len(places)))
            for r in rows:
                matrix[r[0], [at[p] for p in found[r[0]][view]]] = 1
            w = plain_fit(matrix[fit], y, cotrain.PENALTY[view])
            m = matrix @ w[:-1] + w[-1]
            slope, constant = plain_calibration(m[check][:, None], np.array([known[i][head] for i in check], dtype=float))
            for label in (1, 0):
                sign = 1 if label else -1
                z = {i: sign * (m[i] * slope + constant) for i in pool}
                mine = [names[k] for _, k, h, v, c in handed if (h, v, c) == (head, other, label)]
                assert not used & set(mine)
                sure = sorted((z[i] for i in z if z[i] >= math.log(19) and i not in used), reverse=True)
                expected = sure[: int(cotrain.HANDED * (y == label).sum())]
                used |= set(mine)
                count += len(mine)
                assert np.allclose(sorted((z[i] for i in mine), reverse=True), expected, atol=0.02)  # rows of equal margins may stand for each other
    assert count == len(handed) > 20


def test_learns_with_nulls_in_the_metadata(spark):
    rows, labels, docs, label_table = table(spark, nulls=True)
    got = {r["doc_id"]: r for r in cotrain.classify(docs, label_table).collect()}
    toxic = {r[0]: "rude" in r[1].split() for r in rows}
    junk = {r[0]: "junk" in r[1].split() for r in rows}
    assert np.mean([(got[i]["p_toxic"] >= 0.5) == toxic[i] for i in toxic]) > 0.9
    assert np.mean([(got[i]["p_quality"] < 0.5) == junk[i] for i in junk]) > 0.85


def test_bounds_and_repeats(spark):
    _, labels, docs, label_table = table(spark, 300)
    few = cotrain.classify(docs, label_table, max_labelled=60)
    assert few.count() == 300
    twice = cotrain.classify(docs.unionByName(docs), label_table.unionByName(label_table))
    once = {r["doc_id"]: r for r in cotrain.classify(docs, label_table).collect()}
    got = twice.collect()
    assert len(got) == 600 and all(math.isclose(r["p_toxic"], once[r["doc_id"]]["p_toxic"], abs_tol=1e-9) for r in got)


def test_one_class_only(spark):
    _, labels, docs, _ = table(spark, 90)
    ones = spark.createDataFrame([(i, 1, None) for i, *_ in labels], "doc_id long, quality int, toxic int")
    got = cotrain.classify(docs, ones).collect()
    assert {r["p_quality"] for r in got} == {1.0} and {r["p_toxic"] for r in got} <= {0.0, 0.5}


@pytest.mark.parametrize("view", cotrain.VIEWS)
def test_fit_reaches_the_optimum(view):
    rng = np.random.default_rng(3)
    x = (rng.random((200, 30)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(scale=0.3, size=200) > 0.8).astype(float)
    rows = cotrain.Rows.of([np.flatnonzero(r).astype(np.int32).tobytes() for r in x])
    w, constant = cotrain.fit_view(rows, y, cotrain.PENALTY[view], 64)
    best = plain_fit(x, y, cotrain.PENALTY[view])

    def loss(w):
        share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        z = x @ w[:-1] + w[-1]
        return (share * np.log1p(np.exp(-(2 * y - 1) * z))).sum() + cotrain.PENALTY[view] * np.abs(w[:-1]).sum()

    assert loss(np.r_[w[:30], constant]) <= loss(best) + 1e-5


def test_words_with_and_without_marks():
    features = cotrain.Features()
    text = "Don't STOP, don't! x-y\tä-b\n(end) stop,"
    low = text.encode().lower()
    words = set(low.split()) | set(low.translate(cotrain._BARE).split())
    assert features(text, None, None, None)[0].tolist() == sorted({features.words[w] for w in words})


def test_texts_are_read_as_features_once(spark, monkeypatch):
    """However many rounds score all documents."""
    _, _, docs, label_table = table(spark, 120)
    seen, featured = [], cotrain.featured

    def counted(rows):
        seen.append(rows.count())
        return featured(rows)

    monkeypatch.setattr(cotrain, "featured", counted)
    assert cotrain.classify(docs, label_table).count() == 120 and seen == [120]
