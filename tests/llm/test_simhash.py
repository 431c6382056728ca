"""Fingerprints and their components against plain Python."""

import random
from collections import Counter

import pytest
import xxhash

from tabloom.llm import simhash
from tabloom.llm.common import Scratch
from . import brute
from .conftest import edge_rows

EDGE = [(r[0], r[1]) for r in edge_rows()]


def table(rows):
    return Counter(map(tuple, rows))


def plain_fingerprint(text):
    w = brute.words(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """Partners per place and the smallest place that links reach."""
    near, label = [0] * len(fps), list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                near[i] += 1
                near[j] += 1
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return near, [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["edge", "small"])
def test_contract(which, edge, small):
    docs, rows = (edge, EDGE) if which == "edge" else small
    fps = [plain_fingerprint(t) for _, t in rows]
    near, classes = linked(fps)
    ids = brute.smallest_ids(rows, classes)
    expected = [(i, f"{f:016x}", c, n) for (i, _), f, c, n in zip(rows, fps, ids, near)]
    assert table(simhash.simhash_components(docs).collect()) == table(expected)


def clusters(seed, n):
    """Random fingerprints, dense balls around some of them, and chains."""
    rng, out = random.Random(seed), set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            if rng.random() < 0.1:
                centre = x
    out = sorted(out)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most_members", [simhash.TASK_NODES, 16])
def test_tries_find_every_pair_once(spark, monkeypatch, most_members):
    monkeypatch.setattr(simhash, "TASK_NODES", most_members)  # 16: dense tries are cut several times
    fps = clusters(3, 900)
    near, classes = linked(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, 2) for f in fps]
    found = simhash.trie_join(simhash.dealt(spark.createDataFrame(rows, "fp long, copies long"), Scratch(spark))).collect()
    got, place = Counter(), {f: i for i, (f, _) in enumerate(rows)}
    for r in found:
        got[place[r["fp"]]] += r["near"]
    assert [got[i] for i in range(len(fps))] == [2 * n for n in near]  # two copies of each partner
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in found:
        x, y = sorted((root(place[r["fp"]]), root(place[r["root"]])))
        label[y] = x
    assert [root(i) for i in range(len(fps))] == classes


def test_cuts_are_a_partition_and_end():
    for path in (4, 7, 4 * 4 + 2, ((4 * 4 + 1) * 4 + 3) * 4):
        agreed, differ, left = simhash.layout(path)
        assert agreed & simhash.mask_of(left) == 0 and all(m & ~agreed for m in differ)  # each may still differ
        assert agreed | simhash.mask_of(left) == (1 << 64) - 1
    path = 1
    while len(simhash.layout(path)[2]) > 13:
        path *= 4
    assert 1 << len(simhash.layout(path)[2]) <= simhash.TASK_NODES and path <= 4**7


def test_many_copies_of_few_texts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('one two three four five six ', id % 2) AS text", "id % 7 AS fp")
    got = simhash.simhash_components(docs).collect()
    same = len({r["fingerprint"] for r in got}) == 1 or (int(got[0]["fingerprint"], 16) ^ int(got[1]["fingerprint"], 16)).bit_count() <= 3
    assert {r["component_id"] for r in got} == ({0} if same else {0, 1})
    assert {r["n_links"] for r in got} == {2999 if same else 1499}


def test_nothing(nothing):
    assert simhash.simhash_components(nothing).count() == 0
