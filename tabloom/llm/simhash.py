"""SimHash near-duplicates by a self-join of binary tries.

Equal fingerprints are one. 64 bits are cut into MOST + 1 blocks, so that two fingerprints within MOST bits
agree on a block; those that agree on one hang in one trie over their other bits. A trie
with more than TASK_NODES members is cut again by blocks of its remaining bits, until each fits one
task. The self-join walks pairs of nodes from (root, root) downwards, adds up the bits in which
the two prefixes differ and leaves a pair as soon as these exceed MOST.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, join_repeated, read, text_of
from .components import components

WIDTH = 3
SEED = 42
MOST = 3
BITS = 64
#: Members of a trie; with at most 13 bits left a trie cannot have more, so cutting always ends.
TASK_NODES = 1 << 13
#: Pairs of nodes with at most so many pairs of members are compared member by member.
LEAF_PAIRS = 64
CHUNK = 1 << 21
#: What one walk holds: members, tries and the sum of their squared sizes.
WALK_NODES, WALK_TRIES, WALK_PAIRS = 1 << 16, 1 << 15, 1 << 27
#: Bytes of shingle hashes unpacked at once.
HASHES = 1 << 14
BROADCAST_TRIES = 100_000
SALTS = 16


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits, each 1 if more than half of the shingles' hashes have it; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # ASCII rules on bytes
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    if len(words) < width:
        hashes = [hash64(joined, SEED)]
    else:
        hashes = [hash64(joined[a : b - 1], SEED) for a, b in zip(ends, ends[width:])]
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), HASHES):
        part = np.array(hashes[i : i + HASHES], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """doc_id and the fingerprint as a signed number, per row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, fp long")


# --- how fingerprints are dealt to tries ----------------------------------------------------


def cuts(places: list[int]) -> list[list[int]]:
    """The places of bits in MOST + 1 runs of nearly equal length."""
    k = MOST + 1
    at = [len(places) * i // k for i in range(k + 1)]
    return [places[a:b] for a, b in zip(at, at[1:])]


def mask_of(places: list[int]) -> int:
    return sum(1 << p for p in places)


def layout(path: int) -> tuple[int, list[int], list[int]]:
    """(mask of the agreed bits, masks that must differ, places of the other bits from the top).

    `path` is 1 for no cut; cutting a trie by its i-th block makes it path * (MOST + 1) + i. Two
    members agree on that block and differ on all blocks before it, so every pair within MOST
    bits belongs to exactly one trie.
    """
    k, steps = MOST + 1, []
    while path > 1:
        steps.append(path % k)
        path //= k
    agreed, differ, left = 0, [], list(range(BITS - 1, -1, -1))
    for step in reversed(steps):
        blocks = cuts(left)
        agreed |= mask_of(blocks[step])
        differ += [mask_of(b) for b in blocks[:step]]
        left = [p for p in left if p not in set(blocks[step])]
    return agreed, differ, left


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cut(tries: DataFrame, paths: list[int]) -> DataFrame:
    """Deal the members of tries with these paths to the tries of the next cut."""
    k = MOST + 1
    masks = F.create_map(*[x for p in paths for x in (F.lit(p), F.array(*[F.lit(signed(layout(p * k + i)[0])) for i in range(k)]))])
    dealt = F.transform(
        F.element_at(masks, F.col("path")),
        lambda m, i: F.struct((F.col("path") * k + i).alias("path"), F.col("fp").bitwiseAND(m).alias("agreed")),
    )
    return tries.select("fp", "copies", F.inline(dealt))


def dealt(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, copies, path, agreed): every fingerprint in its tries, none above TASK_NODES members."""
    tries = cut(nodes.select("fp", "copies", F.lit(1).alias("path")), [1])
    done, key = [], ["path", "agreed"]
    while True:
        large = scratch.keep(tries.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > TASK_NODES).select(*key), "large-tries")
        n = large.count()
        if not n:
            done.append(tries)
            break
        if n <= BROADCAST_TRIES:
            side, on, rows = F.broadcast(large), key, tries
        else:  # large tries are hot keys
            side, on = large.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), [*key, "salt"]
            rows = tries.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        done.append(rows.join(side, on, "left_anti").select(*tries.columns))
        paths = [r["path"] for r in large.select("path").distinct().collect()]  # at most (MOST + 1) to the number of cuts
        tries = scratch.keep(cut(rows.join(side, on, "left_semi").select(*tries.columns), paths), "cut-tries")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


# --- the walk -------------------------------------------------------------------------------


def rest_of(fp: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits at these places side by side, the first on top."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for p in places:
        out = (out << np.uint64(1)) | ((fp >> np.uint64(p)) & np.uint64(1))
    return out


def member_pairs(lo1, n1, lo2, n2):
    """Places (i, j) of all pairs of members of the node pairs, in pieces of CHUNK and a little more."""
    sizes = n1 * n2
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK)))
        part = slice(first, last)
        which = np.repeat(np.arange(first, last), sizes[part])
        at = np.arange(len(which)) - np.repeat(ends[part] - sizes[part] - (ends[first] - sizes[first]), sizes[part])
        i, j = lo1[which] + at // n2[which], lo2[which] + at % n2[which]
        yield i[i < j], j[i < j]  # pairs of unlike nodes lie in order; of a node with itself half remain
        first = last


def walk(keys: np.ndarray, bits: int, starts: np.ndarray, ends: np.ndarray):
    """Pairs (i, j) of places in `keys` that differ in at most MOST bits, in pieces.

    `keys` are sorted; [starts, ends) are the members of each trie, whose lowest `bits` bits it
    spells out. A node is a range of places, a pair of nodes two ranges and the bits in which
    their prefixes differ.
    """
    lo1, hi1, lo2, hi2 = starts, ends, starts, ends
    diff = np.zeros(len(starts), dtype=np.int64)
    for bit in range(bits - 1, -2, -1):
        same = lo1 == lo2
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF_PAIRS) | (bit < 0)
        yield from member_pairs(lo1[small], (hi1 - lo1)[small], lo2[small], (hi2 - lo2)[small])
        large = ~small
        if bit < 0 or not large.any():
            return
        lo1, hi1, lo2, hi2, diff, same = (x[large] for x in (lo1, hi1, lo2, hi2, diff, same))
        above, one = np.uint64(bit + 1), np.uint64(1 << bit)
        mid1 = np.searchsorted(keys, ((keys[lo1] >> above) << above) | one)
        mid2 = np.searchsorted(keys, ((keys[lo2] >> above) << above) | one)
        near = ~same & (diff < MOST)
        turn = near | (same & (diff < MOST))  # zeros of the first with ones of the second
        kids = [
            (lo1, mid1, lo2, mid2, diff, np.ones(len(lo1), bool)),
            (mid1, hi1, mid2, hi2, diff, np.ones(len(lo1), bool)),
            (lo1, mid1, mid2, hi2, diff + 1, turn),
            (mid1, hi1, lo2, mid2, diff + 1, near),
        ]
        parts = []
        for a, b, c, d, e, wanted in kids:
            there = wanted & (a < b) & (c < d) & ~((a == c) & (b - a == 1) & (d - c == 1))
            parts.append([x[there] for x in (a, b, c, d, e)])
        lo1, hi1, lo2, hi2, diff = (np.concatenate(x) for x in zip(*parts))


def hang(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j: every place names the smallest place it is joined with."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


FOUND = pa.schema([("fp", pa.int64()), ("root", pa.int64()), ("near", pa.int64())])


def trie_links(path: int, fp: np.ndarray, trie: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    """Of several tries of one path: per member with a link the smallest place it reaches here and the copies of its partners."""
    _, differ, left = layout(path)
    keys = (trie.astype(np.uint64) << np.uint64(BITS - 16)) | rest_of(fp, left)  # at most 48 bits are left
    order = np.argsort(keys, kind="stable")
    keys, fp, trie, copies = keys[order], fp[order], trie[order], copies[order]
    starts = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1]])
    ends = np.r_[starts[1:], len(trie)]
    several = ends - starts > 1
    label, near = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
    for i, j in walk(keys, len(left), starts[several], ends[several]):
        change = fp[i] ^ fp[j]
        good = np.bitwise_count(change) <= MOST
        for mask in differ:
            good &= (change & np.uint64(mask)) != 0
        i, j = i[good], j[good]
        np.add.at(near, i, copies[j])
        np.add.at(near, j, copies[i])
        label = hang(label, i, j)
    linked = near > 0
    out = [fp[linked].view(np.int64), fp[label[linked]].view(np.int64), near[linked]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=FOUND)


def trie_join(tries: DataFrame) -> DataFrame:
    """(fp, root, near) per fingerprint and trie in which it has a link; `root` is another member it reaches there."""
    key = ["path", "agreed"]
    sorted_rows = tries.repartition(*key).sortWithinPartitions(*key)

    def whole_tries(batches):
        """(path, fingerprints, copies) of each trie with several members."""
        name, parts = None, []

        def joined():
            fp, copies = (np.concatenate(x) for x in zip(*parts))
            return name[0], fp.view(np.uint64), copies

        for batch in batches:
            path, agreed, fp, copies = (batch.column(c).to_numpy() for c in ("path", "agreed", "fp", "copies"))
            edges = np.flatnonzero((path[1:] != path[:-1]) | (agreed[1:] != agreed[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(path)]):
                if a == b:
                    continue
                if name != (path[a], agreed[a]):
                    if sum(len(p[0]) for p in parts) > 1:
                        yield joined()
                    name, parts = (path[a], agreed[a]), []
                parts.append((fp[a:b], copies[a:b]))
        if sum(len(p[0]) for p in parts) > 1:
            yield joined()

    def walks(batches):
        """Tries of one path, as many as one walk may hold."""
        held, members, pairs = [], 0, 0
        for path, fp, copies in whole_tries(batches):
            n = len(fp)
            if held and (held[0][0] != path or len(held) >= WALK_TRIES or members + n > WALK_NODES or pairs + n * n > WALK_PAIRS):
                yield held
                held, members, pairs = [], 0, 0
            held.append((path, fp, copies))
            members, pairs = members + n, pairs + n * n
        if held:
            yield held

    def run(batches):
        for held in walks(batches):
            trie = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
            yield trie_links(int(held[0][0]), np.concatenate([h[1] for h in held]), trie, np.concatenate([h[2] for h in held]))

    return sorted_rows.mapInArrow(run, "fp long, root long, near long")


def simhash_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lower-case hex digits), component_id, n_links.

    Words are split at ASCII gaps and A-Z lower-cased; a text of fewer than `width` words is one
    shingle; null and empty texts and those without words have fingerprint zero and are linked
    like any other. n_links counts the other documents within MOST bits, copies included.
    component_id is the smallest doc_id among the documents that links connect; null ids take
    part but never name a component that holds another id. Repeated rows are copies of each
    other. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    marked = scratch.keep(fingerprints(rows, width), "fingerprints")
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "fingerprint-nodes")
    found = scratch.keep(trie_join(dealt(nodes, scratch)), "trie-links")
    roots = components(found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")), "fingerprint-roots")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    known = (
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .join(near, "fp", "left")
        .withColumn("n_links", F.col("copies") - 1 + F.coalesce("near", F.lit(0)))
    )
    known = scratch.keep(known.where("n_links > 0").select("fp", "root", "first_id", "copies", "n_links"), "fingerprint-links")
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = join_repeated(known, least, "root", "members", F.col("fp"))
    result = join_repeated(marked, named.select("fp", "component_id", "n_links", "copies"), "fp", "copies", F.xxhash64("doc_id", "fp"))
    return result.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def op13_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
