"""Spelling variants against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import spelling
from . import brute
from .conftest import edge_rows

EDGE = [(r[0], r[1]) for r in edge_rows()]


def table(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("which", ["edge", "small"])
def test_contract(which, edge, small):
    docs, rows = (edge, EDGE) if which == "edge" else small
    got = spelling.spelling_variants(spelling.word_counts(docs, planted=True)).collect()
    assert table(got) == table(brute.spelling_rows(brute.spelling_counts(rows)))


def family_counts(seed, n):
    """Words with misspellings one and more letters away, in counts of every size; short and very long ones."""
    rng = random.Random(seed)
    letters = "abcdeéÿ×z"
    counts = {}
    for _ in range(n):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 7, 9, 12, 40, 300])))
        k = rng.choice([2000, 300, 20])
        for _ in range(8):
            counts[word] = max(1, k)
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", *letters]) + word[at + rng.randrange(2) :]
            k = k * rng.choice([1, 0.1, 0.05]) // 1 or 1
            if not word:
                break
    return {w: int(k) for w, k in counts.items()}


def test_chains_ties_and_passes(spark, monkeypatch):
    counts = family_counts(3, 60)
    rows = spark.createDataFrame([*counts.items(), (None, 50)], "word string, n long")
    expected = table(brute.spelling_rows({w: k for w, k in counts.items() if k >= 2}))
    assert table(spelling.spelling_variants(rows).collect()) == expected
    assert any(form and root != form for _, form, root, *_ in expected)
    monkeypatch.setattr(spelling, "FILTER_BYTES", 128)  # many passes, lengths in several hash parts
    assert table(spelling.spelling_variants(rows.repartition(3)).collect()) == expected


def test_filters_miss_no_neighbour():
    counts = family_counts(5, 40)
    words = [w for w in counts if len(w) == 9]
    points = spelling.letters(words)
    h = spelling.hashes(points)
    shard = spelling.planned({9: len(words)})[0][9]
    _, block, bits = shard.places(h)
    shard.words = np.zeros(shard.blocks * 8, dtype=np.uint64)
    for k in range(spelling.PROBES):
        bit = (bits >> np.uint64(9 * k)) & np.uint64(511)
        np.bitwise_or.at(shard.words, block * 8 + (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
    assert len(shard.holds(h)) == len(words)
    longer = [w[:4] + "q" + w[4:] for w in words]
    found = set(zip(*(x.tolist() for x in spelling.deletions(spelling.letters(longer), shard))))
    assert {(i, 4) for i in range(len(words))} <= found
    swapped = [w[:3] + "a" + w[4:] for w in words]
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), dtype=np.uint64)
    got = {(r, k, chr(c)) for piece in spelling.replacements(spelling.letters(swapped), alphabet, shard) for r, k, c in zip(*(x.tolist() for x in piece))}
    assert {(i, 3, w[3]) for i, w in enumerate(words) if w[3] > "a"} <= got


def test_counts_without_planting(spark):
    docs = spark.createDataFrame([(1, "Straßen STRASSEN straßen-Fahrt", "x"), (1, None, "x"), (None, "straßen", "x")], "doc_id long, text string, word string")
    assert table(spelling.word_counts(docs).collect()) == Counter({("straßen", 3): 1, ("strassen", 1): 1})


def test_nothing(nothing, spark):
    assert spelling.spelling_variants(spelling.word_counts(nothing, planted=True)).count() == 0
    alone = spark.createDataFrame([("lonelyword", 5)], "word string, n long")
    assert [tuple(r) for r in spelling.spelling_variants(alone).collect()] == [("lonelyword", None, "lonelyword", 5, 0, None)]
