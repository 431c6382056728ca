"""Periodic runs against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import runs
from . import brute
from .conftest import edge_rows

EDGE = [(r[0], r[1]) for r in edge_rows()]


def table(rows):
    return Counter(map(tuple, rows))


def texts_of(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        w, size = [], rng.choice([5, 15, 40, 120, 400])
        while len(w) < size:
            k = rng.choice([1, 2, 3, 5, 8, 20, 40])
            unit = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(k)]
            w += (unit * rng.choice([1, 1, 2, 3, 6, 15]))[: rng.randrange(1, 400)]
        yield w


def runs_in(fragments):
    best = {}
    for q, a, b in fragments:
        if b - a >= max(q, 12 - q):
            best[a, b - a + q] = min(q, best.get((a, b - a + q), q))
    return sorted((a, n, q) for (a, n), q in best.items())


def test_tiles_find_what_plain_search_finds():
    for texts in zip(*[texts_of(1, 600)] * 4):
        found = runs.solve([np.array(w, dtype=np.int32) for w in texts])
        assert [runs_in(f) for f in found] == [brute.runs_of(w) for w in texts]


def test_pieces_of_long_texts_stitch_to_the_same_runs(monkeypatch):
    monkeypatch.setattr(runs, "PIECE_WORDS", 64)
    monkeypatch.setattr(runs, "SHARED_OCTAVES", 3)
    for w in texts_of(2, 300):
        ids, fragments = np.array(w, dtype=np.int32), []
        for octave, after, low, high, base, end in runs.pieces_of(len(w)):
            fragments += runs.solve_piece(ids[base:end], base, low, high, (octave, after))
        assert runs_in(runs.merged(fragments)) == brute.runs_of(w)


def test_z_function():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        z = runs.z_function(s)
        assert z[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


@pytest.mark.parametrize("which", ["edge", "small"])
def test_contract(which, edge, small):
    docs, rows = (edge, EDGE) if which == "edge" else small
    got = runs.report(runs.periodic_runs(runs.planted(docs), texts=False)).collect()
    assert table(got) == table(brute.runs_row(i, brute.planted_runs(i, t)) for i, t in rows)


def test_long_texts_in_pieces(spark):
    """Periods of all octaves in a text far beyond a piece."""
    rng = random.Random(6)
    w = []
    for period in (1, 3, 7, 100, 5000, 40_000):
        unit = [f"u{rng.randrange(10**6)}" for _ in range(period)]
        w += (unit * max(3, 60 // period))[: period * 3 + 40 if period > 30 else None] + [f"x{rng.randrange(10**6)}" for _ in range(50)]
    assert len(w) > 2 * runs.PIECE_WORDS
    docs = spark.createDataFrame([(1, " ".join(w), 5), (2, "short", 5)], "doc_id long, text string, period int")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    found = [tuple(r) for r in got[1]["runs"]]
    starts, at = [], 0
    for period in (1, 3, 7, 100, 5000, 40_000):
        n = 3 * period + 40 if period > 30 else max(3, 60 // period) * period
        n = min(n, max(3, 60 // period) * period)
        starts.append((at, n, period))
        at += n + 50
    assert found == starts
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in starts)]
    assert got[1]["collapsed"] == " ".join(kept) and got[2]["runs"] == [] and got[2]["collapsed"] is None


def test_nothing(nothing):
    assert runs.report(runs.periodic_runs(nothing)).count() == 0
