"""Spelling variants of a corpus vocabulary, found through Bloom-guided neighbourhoods.

The vocabulary is put into blocked Bloom filters, sharded by word length and broadcast in passes
of bounded size. Every word generates its one-letter deletions and replacements and probes the
shards of their lengths, as hashes only; what the filters let through is spelled out and
shuffled to an exact join with the vocabulary, which removes false positives. An insertion is the
deletion of the longer word, and of two words that differ in one letter the one with the smaller letter generates
the other, so every near pair is probed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, ascii_lower, read, text_of
from .jaccard import M1, M2, M3, finished

#: Maximal runs of Latin letters.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A word's form occurs at least so many times as often.
RATIO = 10
#: One run in so many loses a letter in the contract's query.
PLANTED = 31
#: Filters broadcast at once; a vocabulary that needs more is probed in several passes.
FILTER_BYTES = 1 << 26
BITS_PER_WORD = 16
BLOCK = 512  # bits
PROBES = 6
#: Words of this length and more share their shards.
LONGEST = 4096
#: Neighbours whose hashes are made at once.
EDITS = 1 << 20


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def terms(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a code point at a place adds to the hash of its word."""
    with np.errstate(over="ignore"):
        return finished((points + np.uint64(1)) * M1 + places.astype(np.uint64) * M2)


def hashes(points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return terms(points, np.arange(points.shape[1])[None, :]).sum(1, dtype=np.uint64)


@dataclass
class Shard:
    """The filter of the words of one length, or of one of `parts` hash parts of them."""

    parts: int
    part: int
    blocks: int
    words: np.ndarray | None = None  # 8 numbers of 64 bits per block

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash belongs here, its block, and the bits it sets, nine digits each."""
        with np.errstate(over="ignore"):
            h = finished(h)
            bits = finished(h + M3)
        mine = h % np.uint64(self.parts) == self.part
        return mine, ((h >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64), bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places in `h` that may be words."""
        mine, block, bits = self.places(h)
        at = np.flatnonzero(mine)
        for k in range(PROBES):
            bit = (bits[at] >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)
            word = self.words[block[at] * 8 + (bit >> np.uint64(6)).astype(np.int64)]
            at = at[(word >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        return at


def planned(counts: dict[int, int]) -> list[dict[int, Shard]]:
    """Passes of shards by length, each within FILTER_BYTES."""
    passes, room = [{}], FILTER_BYTES
    for length, n in sorted(counts.items()):
        size = -(-n * BITS_PER_WORD // BLOCK) * BLOCK // 8
        parts = -(-size // FILTER_BYTES)
        for part in range(parts):
            blocks = max(1, -(-n * BITS_PER_WORD // (BLOCK * parts)))
            if blocks * BLOCK // 8 > room or length in passes[-1]:
                passes.append({})
                room = FILTER_BYTES
            passes[-1][length] = Shard(parts, part, blocks)
            room -= blocks * BLOCK // 8
    return passes if passes[0] else []


def by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups.items()


WORDS = [f"w{k}" for k in range(8)]


def filled(vocabulary: DataFrame, shards: dict[int, Shard]) -> dict[int, Shard]:
    """The shards with their bits: ORed per block inside tasks, then across them."""
    schema = pa.schema([("length", pa.int32()), ("block", pa.int64())] + [(c, pa.int64()) for c in WORDS])

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, at in by_length(words):
                shard = shards.get(min(length, LONGEST))
                if shard is None:
                    continue
                mine, block, bits = shard.places(hashes(letters([words[i] for i in at])))
                block, bits = block[mine], bits[mine]
                used, inverse = np.unique(block, return_inverse=True)
                out = np.zeros((len(used), 8), dtype=np.uint64)
                for k in range(PROBES):
                    bit = (bits >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)
                    np.bitwise_or.at(out, (inverse, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                columns = [np.full(len(used), min(length, LONGEST), np.int32), used, *out.view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], schema=schema)

    ddl = "length int, block long, " + ", ".join(f"{c} long" for c in WORDS)
    made = vocabulary.select("word").mapInArrow(run, ddl).groupBy("length", "block").agg(*[F.bit_or(c).alias(c) for c in WORDS])
    table = made.toArrow()  # at most FILTER_BYTES / 64 rows
    length, block = table.column("length").to_numpy(), table.column("block").to_numpy()
    bits = np.stack([table.column(c).to_numpy() for c in WORDS], 1).view(np.uint64)
    out = {}
    for key, shard in shards.items():
        words = np.zeros((shard.blocks, 8), dtype=np.uint64)
        mine = length == key
        words[block[mine]] = bits[mine]
        out[key] = Shard(shard.parts, shard.part, shard.blocks, words.ravel())
    return out


def deletions(points: np.ndarray, shard: Shard):
    """(row, place) of the letters without which a word may be in the vocabulary."""
    n, size = points.shape
    with np.errstate(over="ignore"):
        here = np.cumsum(terms(points, np.arange(size)[None, :]), axis=1, dtype=np.uint64)
        shifted = np.cumsum(terms(points[:, 1:], np.arange(size - 1)[None, :])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        before = np.concatenate([np.zeros((n, 1), np.uint64), here[:, :-1]], axis=1)
        after = np.concatenate([shifted, np.zeros((n, 1), np.uint64)], axis=1)
        h = before + after
    first = np.concatenate([np.ones((n, 1), bool), points[:, 1:] != points[:, :-1]], axis=1)  # of equal neighbours one
    row, place = np.nonzero(first)
    found = shard.holds(h[row, place])
    return row[found], place[found]


def replacements(points: np.ndarray, alphabet: np.ndarray, shard: Shard):
    """(row, place, code point) of the replacements by a larger letter that may be in the vocabulary, in pieces."""
    n, size = points.shape
    whole = hashes(points)
    step = max(1, EDITS // (n * len(alphabet)))
    for a in range(0, size, step):
        places = np.arange(a, min(size, a + step))
        part = points[:, places]
        with np.errstate(over="ignore"):
            rest = whole[:, None] - terms(part, places[None, :])
        new = terms(alphabet[None, :], places[:, None])
        row, place, letter = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        with np.errstate(over="ignore"):
            found = shard.holds(rest[row, place] + new[place, letter])
        yield row[found], place[found] + a, alphabet[letter[found]]


def probed(vocabulary: DataFrame, shards: dict[int, Shard], alphabet: list[int]):
    """(word, n, other): neighbours of words that the filters let through; and the broadcast, to be destroyed when they are read."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string())])
    shared = vocabulary.sparkSession.sparkContext.broadcast(shards)
    known = np.array(alphabet, dtype=np.uint64)

    def run(batches):
        filters = shared.value
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for length, at in by_length(words):
                shorter, equal = filters.get(min(length - 1, LONGEST)), filters.get(min(length, LONGEST))
                if shorter is None and equal is None:
                    continue
                some = max(1, EDITS // (length * max(1, len(known))))
                for i in range(0, len(at), some):
                    group = at[i : i + some]
                    points, out = letters([words[g] for g in group]), []
                    if shorter is not None:
                        for r, k in zip(*(x.tolist() for x in deletions(points, shorter))):
                            w = words[group[r]]
                            out.append((w, n[group[r]], w[:k] + w[k + 1 :]))
                    if equal is not None:
                        for piece in replacements(points, known, equal):
                            for r, k, c in zip(*(x.tolist() for x in piece)):
                                w = words[group[r]]
                                out.append((w, n[group[r]], w[:k] + chr(c) + w[k + 1 :]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, other string"), shared


def near_pairs(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, other_n) once per pair of words that differ by one inserted, deleted or replaced code point."""
    size = F.least(F.length("word"), F.lit(LONGEST))
    counts = {r[0]: r[1] for r in vocabulary.groupBy(size.alias("length")).agg(F.count("*")).collect()}  # at most LONGEST rows
    alphabet = sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0])
    parts = []
    for shards in planned(counts):
        found, shared = probed(vocabulary, filled(vocabulary, shards), alphabet)
        parts.append(scratch.keep(found, "bloom-positives"))
        shared.destroy()
    if not parts:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")


def followed(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by doubling the steps; a form is RATIO times as frequent, so chains are short."""
    links = scratch.keep(forms.select("word", F.col("form").alias("root")), "form-chains")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = F.col("_further").isNotNull().alias("moved")
        step = scratch.keep(links.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), moved), "form-chains")
        scratch.drop(links)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        links = step


def spelling_variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Group the words of (word, n), one row per word: word, form, root, n, n_near, form_n.

    Words with n below `least_count` take no part. Near words differ by one inserted, deleted or replaced code
    point. A form is the near word of largest n (of several the smallest in code-point order) if that is at least
    `ratio` times the word's own n; null otherwise. root is the end of the chain of forms, the word
    itself without one. Null words are left out; an empty table gives no rows.
    """
    scratch = Scratch(counts.sparkSession)
    vocabulary = scratch.keep(counts.where(F.col("word").isNotNull() & (F.col("n") >= least_count)).select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = scratch.keep(near_pairs(vocabulary, scratch), "near-words")
    both = pairs.select("word", "other", "other_n").unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("_m"), F.col("other").alias("_w"))).alias("_best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    common = -F.col("_best._m") >= ratio * F.col("n")
    table = vocabulary.join(near, "word", "left").select(
        "word", F.when(common, F.col("_best._w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, -F.col("_best._m")).alias("form_n"),
    )
    table = scratch.keep(table, "spelling-forms")
    roots = followed(table.where("form is not null"), scratch)
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_deletion(word: Column, doc_id: Column) -> Column:
    """The contract's misspellings: a run loses a letter if PLANTED divides crc32 of `<doc_id>:<run>`; a null id changes nothing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    place = (h % F.length(word)).cast("int")
    return F.when(h % PLANTED == 0, F.concat(F.substr(word, F.lit(1), place), F.substr(word, place + 2))).otherwise(word)


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, planted: bool = False) -> DataFrame:
    """(word, n) of the runs of letters of whole texts, A-Z lower-cased, with at least `least_letters` code points.

    A null or empty text has none; repeated rows count each. Counts are combined inside tasks before they are shuffled.
    """
    runs = F.regexp_extract_all(text_of(F.col("text")), F.lit(RUN), F.lit(0))
    words = docs.select("doc_id", F.explode(F.filter(runs, lambda w: F.length(w) >= least_letters)).alias("word"))
    words = words.select("doc_id", ascii_lower(F.col("word")).alias("word"))
    if planted:
        words = words.select(with_deletion(F.col("word"), F.col("doc_id")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def op11_bloom_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(read(spark, sf_dir, "documents"), planted=True))
