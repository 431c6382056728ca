"""Brown class-based bigram model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read, text_of

#: Words with at least this share of the training tokens, core words, are clustered first; there are at most 1 / CORE_SHARE of them.
CORE_SHARE = 1 / 20_000
CLASSES = 64
ROUNDS = 8
#: Classes of all rarer words; class 0 holds words seen once and all unseen words. While the core is clustered the others are classes by the
#: binary logarithm of the count, then every word seen twice or more is exchanged between them by its own neighbours.
BANDS = CLASSES + 1
TAIL_ROUNDS = 2
#: Rarer words whose neighbours a task holds at once, and neighbours of theirs that it weighs at once.
TAIL_WORDS = 20_000
TAIL_ENTRIES = 100_000
#: Weight of the class unigram, in tokens, where a class transition is estimated.
PRIOR = 20.0
#: UTF-8 bytes of text per dictionary block, and blocks per staged file (what a reader holds at once).
BLOCK_BYTES = 8 << 20
BLOCKS_PER_FILE = 2

BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("words", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.int32())),
        ("train_words", pa.int64()),
        ("train_docs", pa.int64()),
    ]
)
BLOCK_DDL = (
    "block long, words array<binary>, counts array<long>, doc_ids array<long>, held array<boolean>, "
    "lengths array<long>, ids array<int>, train_words long, train_docs long"
)


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """Documents of about BLOCK_BYTES with a dictionary of their own."""

    def __init__(self, number: int):
        self.number, self.bytes, self.words, self.docs = number, 0, Numbers(), []

    def add(self, doc_id, held: bool, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        tokens = data.lower().split()  # ASCII rules on bytes: A-Z, and gaps of \x20 \x09-\x0D
        ids = np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        self.docs.append((doc_id, held, ids))
        self.bytes += len(data)

    def row(self) -> pa.RecordBatch:
        train = [ids for _, held, ids in self.docs if not held]
        counts = np.bincount(np.concatenate(train) if train else [], minlength=len(self.words)) if self.words else np.zeros(0, int)
        values = [
            self.number,
            list(self.words),
            counts,
            [d for d, _, _ in self.docs],
            [h for _, h, _ in self.docs],
            [len(i) for _, _, i in self.docs],
            np.concatenate([i for _, _, i in self.docs]),
            int(counts.sum()),
            len(train),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, BLOCK)], schema=BLOCK)


def to_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Tokenize once: documents as numbers into dictionaries of their blocks, with training counts."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 24
        block = Block(part)
        for batch in batches:
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
                block.add(doc_id, held, text.as_py())
                if block.bytes >= block_bytes:
                    yield block.row()
                    block = Block(block.number + 1)
        if block.docs:
            yield block.row()

    return docs.mapInArrow(run, BLOCK_DDL)


#: Documents of a block as numbers into `codes`: the number of a core word, else `core` plus BANDS times the word's training count plus its class.
#: `uids` names the rarer words seen twice or more over all blocks; it is 0 for the others.
CODED = pa.schema([f for f in BLOCK if f.name in ("block", "doc_ids", "held", "lengths", "ids")] + [("codes", pa.list_(pa.int64())), ("uids", pa.list_(pa.int64()))])
CODED_DDL = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, ids array<int>, codes array<long>, uids array<long>"


def with_codes(blocks: DataFrame, lookups: DataFrame) -> DataFrame:
    def encode(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return CODED.empty_table()
        idx, lists = right.column("idx").to_numpy(), []
        for name in ("code", "uid"):
            values = np.zeros(right.num_rows, dtype=np.int64)
            values[idx] = right.column(name).to_numpy()
            lists.append(pa.array([values], pa.list_(pa.int64())))
        return pa.Table.from_arrays([*(left.column(f.name).cast(f.type) for f in list(CODED)[:5]), *lists], schema=CODED)

    needed = blocks.select("block", "doc_ids", "held", "lengths", "ids")
    return needed.groupBy("block").cogroup(lookups.groupBy("block")).applyInArrow(encode, CODED_DDL)


def coded_rows(batches):
    """The columns of each block as arrays."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column("block")[row].as_py(), *(batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in CODED.names[1:])


def training_sequence(held: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The words of the training texts one after the other, -1 before every text and after the last."""
    used = ids[np.repeat(~held, lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths[~held])])
    return np.insert(used.astype(np.int64), ends, -1)


@dataclass
class Model:
    """Everything a scoring task needs; its size is bounded by 1 / CORE_SHARE and the number of classes."""

    core: int
    core_counts: np.ndarray
    train_docs: int
    train_tokens: int
    types: int
    classes: np.ndarray  # of each node: core words, bands, end
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) of core words; log10 of 1 / tokens of the class for classes of rarer words
    unseen: float
    once: float

    @property
    def end(self) -> int:
        return self.core + BANDS

    def score(self, codes: np.ndarray) -> tuple[int, int, float, float]:
        """Tokens, known tokens, base log10 probability and model log10 probability of one text."""
        tail = np.where(codes < self.core, -1, (codes - self.core) // BANDS)
        counts = np.where(tail < 0, self.core_counts[np.minimum(codes, max(self.core - 1, 0))], tail)
        all_counts = np.append(counts, self.train_docs)
        base = np.log10((all_counts + 1) / (self.train_tokens + self.types + 1)).sum()
        nodes = nodes_of(codes, self.core)
        classes = self.classes[nodes]
        moves = self.transition[classes[:-1], classes[1:]].sum()
        words = self.emission[nodes[1:-1]]
        rare = tail > 1
        words = np.where(rare, words + np.log10(np.where(rare, tail, 1)), words)
        words = np.where(tail == 1, self.once, np.where(tail == 0, self.unseen, words))
        return len(codes) + 1, int((all_counts > 0).sum()), float(base), float(moves + words.sum())


def nodes_of(codes: np.ndarray, core: int) -> np.ndarray:
    """End, the words as core numbers or classes of rarer words, end."""
    end = core + BANDS
    return np.concatenate([[end], np.where(codes < core, codes, core + (codes - core) % BANDS), [end]])


def sequence_nodes(sequence: np.ndarray, codes: np.ndarray, core: int) -> np.ndarray:
    """The nodes of a block's training sequence."""
    return np.append(nodes_of(codes, core)[1:-1], core + BANDS)[sequence]  # -1 is the end


def neighbours(coded: DataFrame, core: int) -> DataFrame:
    """One row per node with all its neighbours in training texts: node, side (0: after it), other, n.

    Pairs are counted per task, then summed; a node has at most 2 x (core + BANDS + 1) entries.
    """
    size = core + BANDS + 1
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def count(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(counts)], schema=schema)

        for _, _, held, lengths, ids, codes, _ in coded_rows(batches):
            nodes = sequence_nodes(training_sequence(held, lengths, ids), codes, core)
            new, n = np.unique(nodes[:-1] * size + nodes[1:], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(keys) > 2_000_000:
                yield out(keys, counts)
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out(keys, counts)

    pairs = coded.mapInArrow(count, "a long, b long, n long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    sides = F.inline(
        F.array(
            F.struct(F.col("a").alias("node"), F.lit(0).alias("side"), F.col("b").alias("other"), "n"),
            F.struct(F.col("b").alias("node"), F.lit(1).alias("side"), F.col("a").alias("other"), "n"),
        )
    )
    return pairs.select(sides).groupBy("node").agg(F.collect_list(F.struct("side", "other", "n")).alias("beside"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def entries(batch: pa.RecordBatch, row: int):
    cells = batch.column("beside")[row].values
    return (cells.field(i).to_numpy(zero_copy_only=False) for i in range(3))


def class_matrix(beside: DataFrame, classes: np.ndarray, total: int) -> np.ndarray:
    """Counts of class pairs, summed in Spark to total x total numbers."""

    def run(batches):
        matrix = np.zeros((total, total))
        for batch in batches:
            for row, node in enumerate(batch.column("node").to_pylist()):
                side, other, n = entries(batch, row)
                after = side == 0
                matrix[classes[node]] += np.bincount(classes[other[after]], weights=n[after], minlength=total)
        a, b = np.nonzero(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(matrix[a, b].astype(np.int64))], names=["a", "b", "n"])

    cells = beside.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((total, total))
    matrix[cells["a"].to_numpy(int), cells["b"].to_numpy(int)] = cells["n"].to_numpy(float)
    return matrix


def best_class(node: int, own: int, side, other, n, classes: np.ndarray, matrix: np.ndarray, choices: int) -> tuple[int, float]:
    """The class that raises the likelihood most if the word is taken from `own`, and by how much."""
    total = len(matrix)
    self_pairs = n[(other == node) & (side == 0)].sum()
    foreign = other != node
    after = np.bincount(classes[other[foreign & (side == 0)]], weights=n[foreign & (side == 0)], minlength=total)
    before = np.bincount(classes[other[foreign & (side == 1)]], weights=n[foreign & (side == 1)], minlength=total)
    rest = matrix.copy()
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] -= self_pairs
    rest = np.maximum(rest, 0)
    rows, columns = rest[:choices], rest[:, :choices]
    flat = xlogx(rest)
    gain_rows = xlogx(rows + after) - flat[:choices]
    gain_columns = xlogx(columns + before[:, None]) - flat[:, :choices]
    k = np.arange(choices)
    gain = gain_rows.sum(1) - gain_rows[k, k] + gain_columns.sum(0) - gain_columns[k, k]
    corner = rest[k, k]
    gain += xlogx(corner + after[k] + before[k] + self_pairs) - xlogx(corner)
    out, into = (rest.sum(1) + before)[:choices], (rest.sum(0) + after)[:choices]  # its pairs count for its neighbours anyway
    gain -= xlogx(out + after.sum() + self_pairs) - xlogx(out)
    gain -= xlogx(into + before.sum() + self_pairs) - xlogx(into)
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def exchange(beside: DataFrame, core: int, choices: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all nodes and their pair counts, by exchange rounds.

    In a round every core word of one parity finds, against the class counts of the round's
    start, the class it fits best; all these moves are made together and the likelihood is
    measured anew. The best assignment of all rounds is returned. The driver holds one number
    per core word; words' neighbours stay on the executors.
    """
    total = choices + BANDS + 1
    classes = np.concatenate([np.arange(core) % choices, choices + np.arange(BANDS + 1)])
    best, best_value = None, -np.inf
    for turn in range(rounds + 1):
        matrix = class_matrix(beside, classes, total)
        value = likelihood(matrix)
        if value > best_value:
            best, best_value = (classes, matrix), value
        if turn == rounds:
            break

        def run(batches, classes=classes, matrix=matrix, turn=turn):
            for batch in batches:
                moves = []
                for row, node in enumerate(batch.column("node").to_pylist()):
                    if node < core and (node // choices + node + turn) % 2 == 0:
                        to, gain = best_class(node, classes[node], *entries(batch, row), classes, matrix, choices)
                        if gain > 1e-6:
                            moves.append((node, to))
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moves], pa.int64()) for i in (0, 1)], names=["node", "to"])

        moves = beside.mapInArrow(run, "node long, to long").toPandas()  # at most 1 / CORE_SHARE rows
        if moves.empty and turn:
            break
        classes = classes.copy()
        classes[moves["node"].to_numpy(int)] = moves["to"].to_numpy(int)
    return best


# --- rarer words ----------------------------------------------------------------------------


def pair_matrix(coded: DataFrame, core: int, classes: np.ndarray, total: int) -> np.ndarray:
    """Counts of class pairs in the training texts."""

    def run(batches):
        matrix = np.zeros(total * total, dtype=np.int64)
        for _, _, held, lengths, ids, codes, _ in coded_rows(batches):
            c = classes[sequence_nodes(training_sequence(held, lengths, ids), codes, core)]
            matrix += np.bincount(c[:-1] * total + c[1:], minlength=total * total)
        used = np.flatnonzero(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(matrix[used])], names=["cell", "n"])

    cells = coded.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros(total * total)
    matrix[cells["cell"].to_numpy(int)] = cells["n"].to_numpy(float)
    return matrix.reshape(total, total)


def likelihood(matrix: np.ndarray) -> float:
    return float(xlogx(matrix).sum() - xlogx(matrix.sum(1)).sum() - xlogx(matrix.sum(0)).sum())


def tail_gains(word: np.ndarray, key: np.ndarray, n: np.ndarray, own: np.ndarray, matrix: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """How much the likelihood rises with each word in each of the target classes, for the same word left out of all.

    Entries are sorted by word, each word has some; `key` is side x classes + the class of the neighbour (side 0: after the word). `own` is the
    number of the word's class among the targets, -1 if it is in none. That neighbours may be in the class that the word leaves is left aside.
    """
    total, k = len(matrix), len(targets)
    base = np.concatenate([matrix[targets].T, matrix[:, targets]])  # by key: the cell that a target class shares with the neighbour's
    combos, which = np.unique(key * (n.max() + 1) + n, return_inverse=True)
    cells, more = base[combos // (n.max() + 1)], (combos % (n.max() + 1))[:, None].astype(float)
    joins = xlogx(cells + more) - xlogx(cells)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    gains = np.concatenate([
        np.add.reduceat(joins[which[a:b]], starts[i:j] - a)
        for i, j, a, b in pieces(starts, len(word))
    ])
    mine = own[word]
    inside = np.flatnonzero(mine >= 0)
    stay = np.zeros(len(word))
    at = base[key[inside], mine[inside]]
    stay[inside] = xlogx(at) - xlogx(np.maximum(at - n[inside], 0)) - joins[which[inside], mine[inside]]
    has = np.flatnonzero(own >= 0)
    gains[has, own[has]] += np.add.reduceat(stay, starts)[has]
    for side, sums in ((0, matrix.sum(1)[targets]), (1, matrix.sum(0)[targets])):
        tokens = np.add.reduceat(np.where(key // total == side, n, 0).astype(float), starts)
        rest = np.repeat(sums[None, :], len(starts), 0)
        rest[has, own[has]] = np.maximum(rest[has, own[has]] - tokens[has], 0)
        gains -= xlogx(rest + tokens[:, None]) - xlogx(rest)
    return gains


def pieces(starts: np.ndarray, size: int):
    """Words and their entries, TAIL_ENTRIES or those of one word at a time: (first word, end, first entry, end)."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + TAIL_ENTRIES, side="right")) - 1)
        j = len(starts) if size - starts[i] <= TAIL_ENTRIES else j
        yield i, j, int(starts[i]), int(starts[j]) if j < len(starts) else size
        i = j


CONTEXTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("uid", "idx", "own", "word", "key", "n")])
CONTEXTS_DDL = "bucket long, block long, uid binary, idx binary, own binary, word binary, key binary, n binary"
MOVES = pa.schema([("block", pa.int64()), ("idx", pa.binary()), ("to", pa.binary())])


def tail_moves(coded: DataFrame, core: int, classes: np.ndarray, matrix: np.ndarray, choices: int, words: int, first: bool) -> DataFrame:
    """(block, idx, class) of every rarer word seen twice or more: the class its neighbours fit best.

    In the first round it is the one of the core's class whose neighbours are most like its own, later the best of the classes
    of rarer words, against the counts at the round's start. All texts' pairs are counted, each word's meet in one task.
    """
    total, k = len(matrix), min(choices, BANDS - 1)
    targets = np.arange(k) + (0 if first else choices + 1)
    buckets = max(coded.sparkSession.sparkContext.defaultParallelism, -(-words // TAIL_WORDS))

    def contexts(batches):
        for block, _, held, lengths, ids, codes, uids in coded_rows(batches):
            idx = np.flatnonzero(uids)
            if not len(idx):
                continue
            idx = idx[np.argsort(uids[idx] % buckets, kind="stable")]
            number = np.full(len(codes) + 1, -1)
            number[idx] = np.arange(len(idx))
            sequence = training_sequence(held, lengths, ids)
            c = classes[sequence_nodes(sequence, codes, core)]
            here = number[sequence]
            cells = [number_[some] * (2 * total) + side * total + beside[some]
                     for side, number_, beside in ((0, here[:-1], c[1:]), (1, here[1:], c[:-1])) for some in (number_ >= 0,)]
            cells, n = np.unique(np.concatenate(cells), return_counts=True)
            word, key = cells // (2 * total), cells % (2 * total)
            bucket = uids[idx] % buckets
            own = (codes[idx] - core) % BANDS
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(edges, [*edges[1:], len(idx)]):
                x, y = np.searchsorted(word, [a, b])
                parts = (uids[idx[a:b]], idx[a:b].astype(np.int32), own[a:b].astype(np.uint8), (word[x:y] - a).astype(np.int32), key[x:y].astype(np.int32), n[x:y].astype(np.int64))
                row = [bucket[a], block, *(p.tobytes() for p in parts)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, CONTEXTS)], schema=CONTEXTS)

    def assign(group: pa.Table) -> pa.Table:
        kinds = {"uid": np.int64, "idx": np.int32, "own": np.uint8, "word": np.int32, "key": np.int32, "n": np.int64}
        parts = {c: [np.frombuffer(v, t) for v in group.column(c).to_pylist()] for c, t in kinds.items()}
        uid, at, inverse = np.unique(np.concatenate(parts["uid"]), return_index=True, return_inverse=True)
        sizes = np.array([len(u) for u in parts["uid"]])
        begin = np.cumsum(sizes) - sizes
        cell = inverse[np.concatenate([w + b for w, b in zip(parts["word"], begin)])] * (2 * total) + np.concatenate(parts["key"])
        cell, to = np.unique(cell, return_inverse=True)
        n = np.bincount(to, weights=np.concatenate(parts["n"])).astype(np.int64)
        word, own = cell // (2 * total), np.concatenate(parts["own"])[at].astype(int)
        if first:
            found = 1 + tail_gains(word, cell % (2 * total), n, np.full(len(uid), -1), matrix, targets).argmax(1) if core else 1 + uid % k
        else:
            own = np.where((own > 0) & (own <= k), own - 1, -1)
            gains = tail_gains(word, cell % (2 * total), n, own, matrix, targets)
            best, rows = gains.argmax(1), np.arange(len(uid))
            found = 1 + np.where((own >= 0) & (gains[rows, best] <= gains[rows, own] + 1e-6), own, best)
        found = found.astype(np.uint8)[inverse]
        moved = [found[b : b + m].tobytes() for b, m in zip(begin.tolist(), sizes.tolist())]
        return pa.Table.from_arrays([group.column("block"), pa.array([i.tobytes() for i in parts["idx"]], pa.binary()), pa.array(moved, pa.binary())], schema=MOVES)

    return coded.mapInArrow(contexts, CONTEXTS_DDL).groupBy("bucket").applyInArrow(assign, "block long, idx binary, to binary")


def recoded(coded: DataFrame, moves: DataFrame, core: int, last: bool) -> DataFrame:
    """The blocks with the classes that the moves name; after the last round without the words' names."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return CODED.empty_table()
        codes = left.column("codes")[0].values.to_numpy().copy()
        for idx, to in zip(right.column("idx").to_pylist(), right.column("to").to_pylist()):
            at = np.frombuffer(idx, np.int32)
            codes[at] = core + (codes[at] - core) // BANDS * BANDS + np.frombuffer(to, np.uint8)
        uids = pa.array([[]], pa.list_(pa.int64())) if last else left.column("uids")
        return pa.Table.from_arrays([*(left.column(i) for i in range(5)), pa.array([codes], pa.list_(pa.int64())), uids], names=CODED.names).cast(CODED)

    coded = coded.drop("uids") if last else coded
    return coded.groupBy("block").cogroup(moves.groupBy("block")).applyInArrow(run, CODED_DDL)


def exchange_tail(scratch: Scratch, coded: DataFrame, core: int, classes: np.ndarray, matrix: np.ndarray, choices: int, words: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The blocks with the classes of all words, and the counts of class pairs; a round that lowers the likelihood is the last and does not count."""
    for turn in range(rounds if words else 0):
        moves = scratch.keep(tail_moves(coded, core, classes, matrix, choices, words, not turn), "lm-moves")  # the pairs' shuffle files go
        fresh = scratch.keep(recoded(coded, moves, core, turn + 1 == rounds), "lm-codes", BLOCKS_PER_FILE)
        scratch.drop(moves)
        pairs = pair_matrix(fresh, core, classes, len(matrix))
        if turn and likelihood(pairs) <= likelihood(matrix):
            scratch.drop(fresh)
            break
        scratch.drop(coded)
        coded, matrix = fresh, pairs
    return coded, matrix


def log10_or_floor(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def fit(docs: DataFrame, core_share: float = CORE_SHARE, choices: int = CLASSES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, tail_rounds: int = TAIL_ROUNDS):
    """Fit on the rows of `docs` whose held_out is false; returns (model, the blocks with all documents as codes).

    `docs` has doc_id, held_out and text. The corpus is tokenized once, into blocks with
    dictionaries of their own; one shuffle of the blocks' distinct words gives every word its training count. Core words are
    clustered first, then every other word seen twice or more, by neighbours
    counted anew in each round; words seen once stand for the unseen ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    blocks = scratch.keep(to_blocks(docs, block_bytes), "lm-blocks", BLOCKS_PER_FILE)
    totals = blocks.agg(F.sum("train_words"), F.sum("train_docs")).first()
    train_words, train_docs = totals[0] or 0, totals[1] or 0
    least = max(3.0, core_share * (train_words + train_docs))  # words seen once or twice estimate the unseen ones
    word = Window.partitionBy("word")
    lookups = scratch.keep(
        blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("idx", "_w"))
        .select("block", "idx", F.col("_w.words").alias("word"), F.col("_w.counts").alias("n"))
        .withColumn("row", F.monotonically_increasing_id() + 1)
        .withColumns({"count": F.sum("n").over(word), "uid": F.min("row").over(word)})
        .withColumn("first", F.col("row") == F.col("uid"))
        .select(
            "block", "idx", "count", "first", F.when(F.col("count") >= least, F.col("word")).alias("word"),
            F.when((F.col("count") >= 2) & (F.col("count") < least), F.col("uid")).alias("uid"),
        ),
        "lm-words",
    )
    found = [F.count_if(F.col("count") == c if c else F.col("count") > 0) for c in (0, 1, 2)]
    types, n1, n2, tail = lookups.where("first").agg(*found, F.count("uid")).first()
    core_words = sorted(
        ((r["count"], bytes(r["word"])) for r in lookups.where(F.col("first") & F.col("word").isNotNull()).select("count", "word").collect()),
        key=lambda x: (-x[0], x[1]),
    )  # at most 1 / core_share
    core = len(core_words)
    numbers = spark.createDataFrame([(w, i) for i, (_, w) in enumerate(core_words)], "word binary, number long")
    band = F.floor(F.log2(F.greatest("count", F.lit(1)).cast("double"))).cast("long")
    codes = lookups.join(F.broadcast(numbers), "word", "left").select(
        "block", "idx", F.coalesce(F.col("number"), F.col("count") * BANDS + band + core).alias("code"), F.coalesce("uid", F.lit(0)).alias("uid")
    )
    coded = scratch.keep(with_codes(blocks, codes), "lm-codes", BLOCKS_PER_FILE)
    scratch.drop(blocks, lookups)
    beside = scratch.keep(neighbours(coded, core), "lm-neighbours", 2_000)
    classes, matrix = exchange(beside, core, choices, rounds)
    scratch.drop(beside)
    coded, matrix = exchange_tail(scratch, coded, core, classes, matrix, choices, tail, tail_rounds)
    total = len(matrix)
    arrivals = matrix.sum(0)
    unigram = (arrivals + 1) / (arrivals.sum() + total)
    transition = np.log10((matrix + PRIOR * unigram) / (matrix.sum(1, keepdims=True) + PRIOR))
    core_counts = np.array([c for c, _ in core_words] or [0], dtype=np.int64)
    of_class = np.bincount(classes[:core], weights=core_counts[:core], minlength=total) if core else np.zeros(total)
    emission = np.concatenate(
        [log10_or_floor(core_counts[:core] / np.maximum(of_class[classes[:core]], 1)), -log10_or_floor(np.maximum(arrivals[choices : choices + BANDS], 1)), [0.0]]
    )
    unseen = (n1 + 1) / (n1 + 2 * n2 + 2)  # Good-Turing: what a rare-word slot holds in new text
    model = Model(
        core, core_counts, train_docs, train_words + train_docs, types + (train_docs > 0), classes, transition, emission,
        float(np.log10(unseen)), float(np.log10((1 - unseen) / max(n1, 1))),
    )
    return model, coded


def score(coded: DataFrame, model: Model) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for row, (_, _, _, lengths, ids, codes, _) in enumerate(coded_rows([batch])):
                flat = codes[ids] if len(ids) else ids.astype(np.int64)
                rows = [fitted.score(c) for c in np.split(flat, np.cumsum(lengths)[:-1])] if len(lengths) else []
                tokens, known, base, value = (np.array(x) for x in zip(*rows)) if rows else [np.zeros(0)] * 4
                arrays = [
                    batch.column("doc_ids")[row].values, batch.column("held")[row].values, pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(np.full(len(rows), fitted.train_tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64()),
                    pa.array(10 ** (-value / np.maximum(tokens, 1)), pa.float64()),
                ]
                table = pa.Table.from_arrays(arrays, names=[x.split()[0] for x in ddl.split(", ")])
                yield from table.to_batches(max_chunksize=10_000)

    return coded.mapInArrow(run, ddl)


def scored(docs: DataFrame, held_out=None, **settings) -> DataFrame:
    """Fit on the rows where `held_out` is false and score all of them.

    Null texts count as empty ones: an end alone. A null doc_id is hashed as the empty text,
    which trains. Repeated rows are trained and scored each. Without training rows every
    transition is equally likely and every word unseen; an empty table gives no rows. Other
    columns are not read.
    """
    doc_id = F.col("doc_id")
    if held_out is None:
        held_out = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2
    wanted = docs.select(doc_id.cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(F.col("text")).alias("text"))
    model, coded = fit(wanted, **settings)
    return score(coded, model)


def op1_brown_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
