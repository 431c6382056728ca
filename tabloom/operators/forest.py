"""Decision trees and forests without a depth limit, kept as tables of nodes.

A node of more than SUBTREE_ROWS rows is split level by level, all such nodes of some trees in one pass: features of few
values are tallied per value and merged, for each of the others the rows lie in its order once and chunks of neighbouring rows
are swept from the sums of the chunks before. Once a node's rows fit, they meet in one task, which finishes its whole
sub-tree, all nodes of a level at once. Either way a split lies halfway between two neighbouring values and is the best there is, so
trees do not hang on where a node is split. Features of few values travel as one byte a row and are tallied, not sorted.
Nodes go from the tasks to a table in the shared folder; the driver only sees the few nodes above the sub-trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import dropped, file_system, least_tasks, staged
from .histograms import matrix

#: Rows of a node that one task holds.
SUBTREE_ROWS = 200_000
#: Rows of a chunk of the table in the order of a feature; a task holds one.
CHUNK_ROWS = 200_000
#: Rows times trees that are dealt to tasks at once.
DEALT_ROWS = 50_000_000
#: Different values up to which a feature is kept as one byte a row.
FEW_VALUES = 256
#: Share of the rows with the rarer value up to which a feature of two values is kept as a list of those rows.
RARE_SHARE = 0.25
#: Cells per node and value that a feature may have for each row of a level before its rows are swept in order.
CELLS_PER_ROW = 2
#: Sums of open nodes that a task holds at once, 8 bytes each.
LEVEL_CELLS = 1 << 23
#: Rows times trees whose places a scoring task holds at once.
SCORE_PLACES = 1 << 24
#: Packed trees that a Python worker keeps; more are read again for every batch.
CACHE_BYTES = 1 << 28
PURE = 1e-12


@dataclass(frozen=True)
class Growth:
    """Settings. `classes` is 0 for numbers; `features` how many features a node may use, 0 for all."""

    classes: int
    trees: int = 1
    bootstrap: bool = False
    features: int = 0
    depth: int | None = None
    least_split: int = 2
    seed: int = 42


# --- one sub-tree ---------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def drawn(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson of mean 1 from a hash, so that a row's draws hang on its key alone."""
    with np.errstate(over="ignore"):
        h = mixed(key.astype(np.uint64) + np.uint64(seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15))
    u = (h >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]), u, side="right").astype(float)


def feature_ranks(nodes: np.ndarray, width: int, tree: int, slot: int, seed: int) -> np.ndarray:
    """A random order of the features per node; node numbers are those of the sub-tree."""
    with np.errstate(over="ignore"):
        h = nodes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)[None, :]
        h = mixed(mixed(h) + np.uint64(seed * 7919 + tree * 104_729 + slot + 1))
    return h.argsort(1).argsort(1)


def sums_of(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """What a split is judged by: class weights, or weight and weighted value; then what the impurity needs."""
    if classes:
        return w[:, None] * (y[:, None] == np.arange(classes))
    return np.stack([w, w * y, w * y * y], 1)


def judged(parts, classes: int) -> np.ndarray:
    """Sum of squares over weight: the larger the sum over both sides, the better the split."""
    return sum(p * p for p in parts) / sum(parts) if classes else parts[1] * parts[1] / parts[0]


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = (low.astype(float) + high) / 2
    return np.where(middle < high, middle, low)


def impurity(s: np.ndarray, classes: int) -> np.ndarray:
    """Gini impurity or variance."""
    if classes:
        return 1 - ((s / s.sum(-1, keepdims=True)) ** 2).sum(-1)
    return np.maximum(s[..., 2] / s[..., 0] - (s[..., 1] / s[..., 0]) ** 2, 0.0)


def weight_of(s: np.ndarray, classes: int) -> np.ndarray:
    return s.sum(-1) if classes else s[..., 0]


NODE_FIELDS = ("feature", "threshold", "left", "right", "rows", "weight", "impurity", "decrease")


def summable(v: np.ndarray) -> np.ndarray:
    """Rounded to multiples of a power of two so small that sums of the values are exact, in any order."""
    digits = 52 - int(np.frexp(np.abs(v).sum())[1])
    return np.ldexp(np.rint(np.ldexp(v, digits)), -digits)


@dataclass
class Columns:
    """Features as 32-bit floats. `codes` number the sorted `values` of those that have few; of the others both are None."""

    floats: list[np.ndarray]
    codes: list[np.ndarray | None]
    values: list[np.ndarray | None]

    @staticmethod
    def of(x: np.ndarray) -> "Columns":
        width = x.shape[1]
        return Columns([np.ascontiguousarray(x[:, f]) for f in range(width)], [None] * width, [None] * width)

    def take(self, rows: np.ndarray) -> "Columns":
        return Columns([c[rows] for c in self.floats], [None if c is None else c[rows] for c in self.codes], self.values)

    def order(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Rows by the last feature, the one before it and so on, then label and weight; neighbouring codes are compared as one number."""
        keys, size = [w, y], 0
        for x, c, v in zip(self.floats, self.codes, self.values):
            if c is None:
                keys.append(x)
                size = 0
            elif size and size * len(v) < 1 << 62:
                keys[-1] = keys[-1] + c.astype(np.int64) * size
                size *= len(v)
            else:
                keys.append(c.astype(np.int64))
                size = len(v)
        return np.lexsort(keys)


def subtree(x: np.ndarray | Columns, y: np.ndarray, w: np.ndarray, growth: Growth, depth: int, tree: int, slot: int) -> dict[str, np.ndarray]:
    """Grow a whole tree over these rows, `depth` levels below the root already used; a level at a time.

    Every split lies halfway between two neighbouring values. A node splits if it has `least_split` rows, is
    impure and some feature varies in it; where none of its drawn features does, the next one that does is taken.
    A feature of few values is tallied per node and value, as long as such cells are not many more than the rows; the
    others are swept in the order of their values. Features of two values, one of them rare, are tallied all at once by the
    rows with the rare one. What splits are judged by is summed exactly, so all ways find the same.
    """
    data = Columns.of(x) if isinstance(x, np.ndarray) else x
    columns, codes = data.floats, data.codes
    n, width = len(y), len(columns)
    k = growth.classes
    shift = 0.0 if k else float(np.average(y, weights=w))
    stats = sums_of(y - shift, w, k)
    exact = np.maximum(summable(w), np.finfo(float).tiny)
    judging = [exact * (y == c) for c in range(k)] if k else [exact, summable(w * (y - shift))]
    numbers = [0 if v is None else int((~np.isnan(v)).sum()) for v in data.values]  # NaN, the last value, goes to the right
    rare: dict[int, int] = {}  # feature: its rare code
    for f, c in enumerate(codes):
        if c is not None and len(data.values[f]) == numbers[f] == 2:
            ones = int(np.count_nonzero(c))
            if min(ones, n - ones) <= RARE_SHARE * n:
                rare[f] = int(ones <= n - ones)
    rare_rows = [np.flatnonzero(codes[f] == code).astype(np.int32) for f, code in rare.items()]
    rare_of = np.repeat(np.arange(len(rare)), [len(r) for r in rare_rows])
    rare_rows = np.concatenate([np.zeros(0, np.int32), *rare_rows])
    others = [f for f in range(width) if f not in rare]
    out: dict[str, list] = {f: [] for f in (*NODE_FIELDS, "sums")}
    total = 0

    def append(count: int, sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
        nonlocal total
        pure = impurity(sums, k)
        for name, values in (
            ("feature", np.full(count, -1)), ("threshold", np.zeros(count)), ("left", np.zeros(count, int)), ("right", np.zeros(count, int)),
            ("rows", rows), ("weight", weight_of(sums, k)), ("impurity", pure), ("decrease", np.zeros(count)), ("sums", sums),
        ):
            out[name].append(values)
        total += count
        return np.arange(total - count, total)

    def entries(name):
        if len(out[name]) > 1:
            out[name] = [np.concatenate(out[name])]
        return out[name][0]

    names = append(1, stats.sum(0, keepdims=True), np.array([n]))

    def large(names: np.ndarray) -> np.ndarray:
        return (entries("rows")[names] >= growth.least_split) & (entries("impurity")[names] > PURE)

    halfway = np.array([float(between(*data.values[f])) if f in rare else 0.0 for f in range(width)])

    def worth(parts: list[np.ndarray]) -> np.ndarray:
        return judged(parts, k)

    names, sizes = names[large(names)], np.array([n])
    rows = np.arange(n)  # the rows of the open nodes, by node
    orders: list[np.ndarray | None] = [None] * width  # the same rows by node and value, of features that are swept
    while len(names) and (growth.depth is None or depth < growth.depth):
        m = len(names)
        node, starts = np.repeat(np.arange(m), sizes), np.cumsum(sizes) - sizes
        held = [j[rows] for j in judging]
        sums = [np.add.reduceat(h, starts) for h in held]
        gains, cuts = np.full((width, m), -np.inf), np.zeros((width, m))

        def tally(f: int, picked: np.ndarray, at: np.ndarray | slice, of: np.ndarray) -> None:
            count, own, values = len(picked), len(data.values[f]), data.values[f]
            cell = of * own + codes[f][rows[at]]
            cells = [np.bincount(cell, weights=h[at], minlength=count * own).reshape(count, own) for h in held]
            here = (sum(cells) if k else cells[0])[:, : numbers[f]] > 0
            left = [c[:, : numbers[f]].cumsum(1) for c in cells]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = worth(left) + worth([s[picked][:, None] - a for s, a in zip(sums, left)])
            gain[~(here & np.isfinite(gain))] = -np.inf
            gain[np.arange(count), numbers[f] - 1 - here[:, ::-1].argmax(1)] = -np.inf  # all rows but those without a value
            best = gain.argmax(1)
            found = gain[np.arange(count), best]
            some = np.flatnonzero(np.isfinite(found))
            best, of = best[some], picked[some]
            gains[f, of] = found[some]
            later = (here[some] & (np.arange(numbers[f]) > best[:, None])).argmax(1)
            cuts[f, of] = between(values[best], values[later])

        def tally_rare() -> None:
            nonlocal rare_rows, rare_of
            inside = np.full(n, -1, dtype=np.int32)
            inside[rows] = node
            at = inside[rare_rows]
            if (at < 0).any():
                rare_rows, rare_of, at = rare_rows[at >= 0], rare_of[at >= 0], at[at >= 0]
            cell = at.astype(np.int64) * len(rare) + rare_of
            filled = np.bincount(cell, minlength=m * len(rare))
            hit = np.flatnonzero((filled > 0) & (filled < np.repeat(sizes, len(rare))))
            to, feature = hit // len(rare), np.array(list(rare))[hit % len(rare)]
            some = [np.bincount(cell, weights=j[rare_rows], minlength=m * len(rare))[hit] for j in judging]
            gain = worth(some) + worth([s[to] - a for s, a in zip(sums, some)])
            gain[~np.isfinite(gain)] = -np.inf
            gains[feature, to] = gain
            cuts[feature, to] = halfway[feature]

        def sweep(f: int, picked: np.ndarray, at: np.ndarray | slice, of: np.ndarray, begin: np.ndarray) -> None:
            if orders[f] is None:
                inside = np.full(n, -1, dtype=np.int32)
                inside[rows] = node
                whole = np.argsort(columns[f], kind="stable").astype(np.int32)
                whole = whole[inside[whole] >= 0]
                by = inside[whole]
                orders[f] = whole[np.argsort(by.astype(np.uint16) if m < 1 << 16 else by, kind="stable")]
            o = orders[f][at]
            v = columns[f][o]
            last = np.flatnonzero((v[1:] > v[:-1]) & (of[1:] == of[:-1]))  # rows that may end a left side
            if not len(last):
                return
            here = of[last]
            left = []
            for j in judging:
                own = j[o]
                upto = np.cumsum(own)
                left.append(upto[last] - (upto[begin] - own[begin])[here])
            gain = worth(left) + worth([s[picked[here]] - a for s, a in zip(sums, left)])
            gain[~np.isfinite(gain)] = -np.inf
            edge = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            best = np.maximum.reduceat(gain, edge)
            hit = np.flatnonzero((gain == np.repeat(best, np.diff(np.r_[edge, len(here)]))) & np.isfinite(gain))
            hit = hit[np.r_[True, here[hit][1:] != here[hit][:-1]]] if len(hit) else hit
            first, to = last[hit], picked[here[hit]]
            gains[f, to] = gain[hit]
            cuts[f, to] = between(v[first], v[first + 1])

        def search(f: int, wanted: np.ndarray | None = None) -> None:
            """The best split by feature f of the wanted nodes."""
            picked, at, of, begin = np.arange(m), slice(None), node, starts
            if wanted is not None:
                picked = np.flatnonzero(wanted)
                if not len(picked):
                    return
                own = sizes[picked]
                begin = np.cumsum(own) - own
                of = np.repeat(np.arange(len(picked)), own)
                at = np.repeat(starts[picked] - begin, own) + np.arange(len(of))
            if numbers[f] == 0 and codes[f] is not None:
                return
            if orders[f] is None and codes[f] is not None and m * len(data.values[f]) <= CELLS_PER_ROW * len(rows):
                tally(f, picked, at, of)
            else:
                sweep(f, picked, at, of, begin)

        if rare:
            tally_rare()
        if growth.features and growth.features < width:
            rank = feature_ranks(names, width, tree, slot, growth.seed).T
            for f in others:
                search(f, rank[f] < growth.features)
            lacking = ~(np.isfinite(gains) & (rank < growth.features)).any(0)
            if lacking.any():  # where none of the drawn features varies, the next one that does
                for f in others:
                    search(f, lacking & (rank[f] >= growth.features))
            varies = np.isfinite(gains)
            varies &= np.where(lacking, rank == np.where(varies, rank, width).min(0), rank < growth.features)
            gains[~varies] = -np.inf
        else:
            for f in others:
                search(f)
        chosen = gains.argmax(0)
        split = np.isfinite(gains[chosen, np.arange(m)])
        if not split.any():
            break
        cut = cuts[chosen, np.arange(m)]
        if not split.all():
            stays = split[node]
            rows, node = rows[stays], node[stays]
        goes_left, by = np.zeros(len(rows), dtype=bool), chosen[node]
        for f in np.unique(chosen[split]).tolist():
            here = np.flatnonzero(by == f)
            goes_left[here] = columns[f][rows[here]] <= cut[node[here]]
        child = 2 * (np.cumsum(split) - 1)[node] + ~goes_left
        count = 2 * int(split.sum())
        child_sums = np.stack([np.bincount(child, weights=stats[rows, i], minlength=count) for i in range(stats.shape[1])], 1)
        parents = names[split]
        names = append(count, child_sums, np.bincount(child, minlength=count))
        entries("feature")[parents], entries("threshold")[parents] = chosen[split], cut[split]
        entries("left")[parents], entries("right")[parents] = names[0::2], names[1::2]
        heavy = entries("weight")[parents] * entries("impurity")[parents]
        below = entries("weight")[names] * entries("impurity")[names]
        entries("decrease")[parents] = heavy - below[0::2] - below[1::2]
        depth += 1
        # the rows of large children move together, in the same order; those of two siblings part
        big = large(names)
        sizes = np.where(big, entries("rows")[names], 0)
        side = np.full(n, -1, dtype=np.int8)
        side[rows] = np.where(big[child], child & 1, -1)
        first = np.cumsum(sizes) - sizes
        places = [np.repeat(first[i::2] - np.cumsum(sizes[i::2]) + sizes[i::2], sizes[i::2]) + np.arange(sizes[i::2].sum()) for i in (0, 1)]

        def parted(order: np.ndarray) -> np.ndarray:
            to, out = side[order], np.empty(int(sizes.sum()), dtype=order.dtype)
            out[places[0]], out[places[1]] = order[to == 0], order[to == 1]
            return out

        orders = [None if o is None else parted(o) for o in orders]
        rows = parted(rows)
        names, sizes = names[big], sizes[big]
    sums = entries("sums")
    value = sums / sums.sum(1, keepdims=True) if k else (sums[:, 1:2] / sums[:, :1] + shift)
    return {**{name: entries(name) for name in NODE_FIELDS}, "value": value}


# --- rows and large nodes -------------------------------------------------------------------

#: A row of the table holds a whole batch of training rows, a column as the bytes of its values.
BLOCK_DDL = "n int, chunk int, key binary, label binary, weight binary, x binary, codes binary"
BLOCK = pa.schema([("n", pa.int32()), ("chunk", pa.int32())] + [(c, pa.binary()) for c in ("key", "label", "weight", "x", "codes")])


def record(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


VALUES = pa.schema([("n", pa.int64()), ("feature", pa.int32()), ("found", pa.binary())])


def few_values(train: DataFrame, width: int) -> tuple[int, list[np.ndarray | None]]:
    """The number of rows and, of each feature with no more than FEW_VALUES different 32-bit floats, these, NaN last."""

    def run(batches):
        n, found = 0, [np.zeros(0, np.float32)] * width
        for batch in batches:
            n += batch.num_rows
            if batch.num_rows and any(v is not None for v in found):
                x = matrix(batch.column("x"), width).astype(np.float32)
                for f in [f for f in range(width) if found[f] is not None]:
                    own = np.unique(np.r_[found[f], np.unique(x[:, f])])
                    found[f] = own if len(own) <= FEW_VALUES else None
        yield record(VALUES, [n] + [0] * (width - 1), range(width), [None if v is None else v.tobytes() for v in found])

    parts = train.select(vector_to_array("features").alias("x")).mapInArrow(run, "n long, feature int, found binary")
    # values of all tasks, then of all together: at most FEW_VALUES per feature come to the driver
    one = parts.groupBy("feature").applyInArrow(shared_values, "n long, feature int, found binary").collect()
    values = {r["feature"]: None if r["found"] is None else np.frombuffer(r["found"], np.float32) for r in one}
    return sum(r["n"] for r in one), [values.get(f) for f in range(width)]


def shared_values(group: pa.Table) -> pa.Table:
    parts, found = group.column("found").to_pylist(), np.zeros(0, np.float32)
    for part in parts:
        if part is not None and found is not None:
            found = np.unique(np.r_[found, np.frombuffer(part, np.float32)])
        if part is None or found is None or len(found) > FEW_VALUES:
            found = None
    n = sum(group.column("n").to_pylist())
    return pa.Table.from_batches([record(VALUES, [n], [group.column("feature")[0].as_py()], [None if found is None else found.tobytes()])])


def row_blocks(train: DataFrame, width: int, by: int | None, values: list[np.ndarray | None], chunks: int = 1) -> DataFrame:
    """`codes` holds the features of few values, x the others. With `by` the blocks are `chunks` of rows that follow each other in that feature."""
    many, few = sides_of(values)
    weight = F.col("_weight") if "_weight" in train.columns else F.lit(1.0)
    key = F.xxhash64("_row_id") if "_row_id" in train.columns else F.xxhash64(vector_to_array("features"), "_label")

    def run(batches):
        from pyspark import TaskContext

        parts, chunk = [], TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), width).astype(np.float32)
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("key", "label", "weight")]
            codes = np.zeros((len(x), len(few)), dtype=np.uint8)
            for i, f in enumerate(few):
                codes[:, i] = np.searchsorted(values[f], x[:, f])
            parts.append((batch.num_rows, *numbers, x[:, many].tobytes(), codes.tobytes()))
            if by is None:
                yield record(BLOCK, *[[v] for v in (parts[0][0], chunk, *parts[0][1:])])
                parts = []
        if parts:
            n, *columns = zip(*parts)
            yield record(BLOCK, [sum(n)], [chunk], *[[b"".join(c)] for c in columns])

    rows = train.select(key.alias("key"), F.col("_label").alias("label"), weight.cast("double").alias("weight"), vector_to_array("features").alias("x"))
    rows = rows.where(F.col("weight") > 0)
    if by is not None:  # rows of one value may part, so that a frequent one does not fill a task
        order = (F.col("x")[by].cast("float"), F.col("key"))
        rows = rows.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, BLOCK_DDL)


def sides_of(values: list[np.ndarray | None]) -> tuple[list[int], list[int]]:
    """The features of many values and those of few."""
    return [f for f, v in enumerate(values) if v is None], [f for f, v in enumerate(values) if v is not None]


def blocks_of(batches, *wanted: str):
    """The wanted columns of each block, those of several features as matrices."""
    kinds = {"key": np.int64, "x": np.float32, "codes": np.uint8}
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            arrays = [np.frombuffer(batch.column(c)[i].as_buffer(), kinds.get(c, np.float64)) for c in wanted]
            yield tuple(a.reshape(n, -1) if c in ("x", "codes") else a for c, a in zip(wanted, arrays))


def draws(key: np.ndarray, weight: np.ndarray, growth: Growth, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that a tree draws, and their weights."""
    if not growth.bootstrap:
        return np.arange(len(key)), weight
    w = weight * drawn(key, tree, growth.seed)
    rows = np.flatnonzero(w > 0)
    return rows, w[rows]


@dataclass
class Top:
    """The nodes of one tree above its sub-trees. `open` nodes are still large, `slots` are left to tasks."""

    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])  # the last on the left, of features of few values
    facts: list[tuple] = field(default_factory=lambda: [(0.0, 0, 0.0, 0.0, 0.0, [0.0])])  # threshold, rows, weight, impurity, decrease, value
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    open: list[int] = field(default_factory=list)
    slots: list[int] = field(default_factory=lambda: [0])

    def places(self, x: np.ndarray, codes: np.ndarray, values: list[np.ndarray | None]) -> np.ndarray:
        """The nodes in which rows end."""
        feature, last, left, right = (np.array(v) for v in (self.feature, self.code, self.left, self.right))
        cut, column = np.array([f[0] for f in self.facts]), np.zeros(len(values), dtype=int)
        for side in sides_of(values):
            column[side] = np.arange(len(side))
        few = np.array([v is not None for v in values])
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            rows = rows[feature[node[rows]] >= 0]
            if not len(rows):
                return node
            at = node[rows]
            goes, coded = np.zeros(len(rows), dtype=bool), few[feature[at]]
            for here, table, limit in ((coded, codes, last), (~coded, x, cut)):
                goes[here] = table[rows[here], column[feature[at[here]]]] <= limit[at[here]]
            node[rows] = np.where(goes, left[at], right[at])


@dataclass
class Sums:
    """What the rows of large nodes are summed by: class weights, or weight and weighted value and its square; then their number.

    Rounded to multiples of powers of two so small that sums over all rows are exact, in any order.
    """

    classes: int
    shift: float
    digits: tuple[int, int, int]  # of weights, values and squares

    @property
    def size(self) -> int:
        return (self.classes or 3) + 1

    @staticmethod
    def of(train: DataFrame, classes: int) -> "Sums":
        weight = F.col("_weight").cast("double") if "_weight" in train.columns else F.lit(1.0)
        r = train.where(weight > 0).agg(F.sum(weight).alias("w"), F.sum(weight * F.col("_label")).alias("y"), F.min("_label").alias("low"), F.max("_label").alias("high")).first()
        shift = 0.0 if classes or not r["w"] else float(np.float32(r["y"] / r["w"]))
        most = max(abs((r["low"] or 0.0) - shift), abs((r["high"] or 0.0) - shift), np.finfo(np.float32).tiny)
        whole = 4 * max(r["w"] or 0.0, 1.0)  # draws of rows add up to less than four times the rows
        return Sums(classes, shift, tuple(52 - int(np.frexp(whole * m)[1]) for m in (1.0, most, most * most)))

    def rows(self, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        def exact(v: np.ndarray, which: int) -> np.ndarray:
            return np.ldexp(np.rint(np.ldexp(v, self.digits[which])), -self.digits[which])

        w = np.maximum(exact(w, 0), 2.0 ** -self.digits[0])
        y = y - self.shift
        own = [w * (y == c) for c in range(self.classes)] if self.classes else [w, exact(w * y, 1), exact(w * y * y, 2)]
        return [*own, np.ones(len(w))]

    def gain(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Of splits, by the sums (along the first axis) of their left sides and of all rows."""
        used = self.classes or 2
        with np.errstate(divide="ignore", invalid="ignore"):
            found = judged(left[:used], self.classes) + judged(whole[:used] - left[:used], self.classes)
        return np.where(np.isfinite(found), found, -np.inf)

    def facts(self, s: np.ndarray) -> tuple[int, float, float, list[float]]:
        """Rows, weight, impurity and value of a node."""
        v = s[:-1]
        value = (v / v.sum()).tolist() if self.classes else [float(v[1] / v[0] + self.shift)]
        return int(s[-1]), float(weight_of(v, self.classes)), float(impurity(v, self.classes)), value


#: The best split of a node by a feature, -inf where it does not vary, with the sums of its left side and of the node.
SPLITS = pa.schema([(c, pa.int32()) for c in ("tree", "node", "feature", "code")] + [("gain", pa.float64()), ("cut", pa.float64()), ("left", pa.binary()), ("sums", pa.binary())])
SPLITS_DDL = "tree int, node int, feature int, code int, gain double, cut double, left binary, sums binary"
CELLS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])


def rows_of_open(block: tuple, values: list[np.ndarray | None], growth: Growth, tops: dict[int, Top]):
    """(tree, the rows it draws that lie in open nodes, the number of the node among them, weights)."""
    key, weight, x, codes = block
    for t, top in tops.items():
        slot = np.full(len(top.feature), -1)
        slot[top.open] = np.arange(len(top.open))
        rows, w = draws(key, weight, growth, t)
        at = slot[top.places(x[rows], codes[rows], values)]
        here = at >= 0
        yield t, rows[here], at[here], w[here]


def tallied_splits(table: DataFrame, values: list[np.ndarray | None], growth: Growth, tops: dict[int, Top], sums: Sums) -> DataFrame:
    """The best splits of the open nodes by features of few values: a task sends one row per node with the sums per feature and value."""
    few, size = sides_of(values)[1], sums.size

    def run(batches):
        cells = {t: np.zeros((size, len(top.open) * len(few) * 256)) for t, top in tops.items()}
        for key, label, weight, x, codes in blocks_of(batches, "key", "label", "weight", "x", "codes"):
            for t, rows, at, w in rows_of_open((key, weight, x, codes), values, growth, tops):
                own = sums.rows(label[rows], w)
                for i in range(len(few)):
                    cell = (at * len(few) + i) * 256 + codes[rows, i]
                    for total, v in zip(cells[t], own):
                        total += np.bincount(cell, weights=v, minlength=len(total))
        for t, top in tops.items():
            per_node = cells[t].reshape(size, len(top.open), len(few) * 256)
            if len(used := np.flatnonzero(per_node[-1].any(1))):
                yield record(CELLS, [t] * len(used), [top.open[i] for i in used], [per_node[:, i].tobytes() for i in used])

    def search(group: pa.Table) -> pa.Table:
        total = np.zeros((size, len(few), 256))
        for part in group.column("sums").to_pylist():
            total += np.frombuffer(part).reshape(total.shape)
        t, node = (group.column(c)[0].as_py() for c in ("tree", "node"))
        whole, out = total[:, 0].sum(1), []
        for i, f in enumerate(few):
            known = values[f][~np.isnan(values[f])]  # NaN, the last value, goes to the right
            here = np.flatnonzero(total[-1, i, : len(known)])
            left = total[:, i, here].cumsum(1)[:, :-1]  # not all rows that have a value
            gain = sums.gain(left, whole[:, None])
            best = int(gain.argmax()) if len(gain) else 0
            if len(gain) and np.isfinite(gain[best]):
                cut = float(between(known[here[best]], known[here[best + 1]]))
                out.append((t, node, f, int(here[best]), float(gain[best]), cut, left[:, best].tobytes(), whole.tobytes()))
            else:
                out.append((t, node, f, 0, -np.inf, 0.0, whole.tobytes(), whole.tobytes()))
        return pa.Table.from_batches([record(SPLITS, *map(list, zip(*out)))])

    found = table.select("n", "key", "label", "weight", "x", "codes").mapInArrow(run, "tree int, node int, sums binary")
    return found.groupBy("tree", "node").applyInArrow(search, SPLITS_DDL)


def swept_splits(table: DataFrame, f: int, values: list[np.ndarray | None], growth: Growth, tops: dict[int, Top], sums: Sums) -> list[tuple]:
    """The best splits of the open nodes by a feature of many values; the rows of `table` lie in its order, a block is a chunk."""
    i, size = sides_of(values)[0].index(f), sums.size
    first, m = {}, 0  # the nodes of all trees are numbered on
    for t, top in tops.items():
        first[t], m = m, m + len(top.open)
    columns = ("key", "label", "weight", "x", "codes")

    def chunks_of(batches):
        for batch in batches:
            yield from zip(batch.column("chunk").to_pylist(), blocks_of([batch], *columns))

    def totals(batches):
        for chunk, (key, label, weight, x, codes) in chunks_of(batches):
            known, lacking, ends = np.zeros((size, m)), np.zeros((size, m)), np.full((2, m), np.nan)
            for t, rows, at, w in rows_of_open((key, weight, x, codes), values, growth, tops):
                at, v = at + first[t], x[rows, i]
                own, nan = sums.rows(label[rows], w), np.isnan(v)
                for total, some in ((known, ~nan), (lacking, nan)):
                    for k in range(size):
                        total[k] += np.bincount(at[some], weights=own[k][some], minlength=m)
                at, v = at[~nan], v[~nan]
                ends[0, at[::-1]], ends[1, at] = v[::-1], v  # of equal places the last assignment stays
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.concatenate([known, lacking, ends]).tobytes()], pa.binary())], names=["chunk", "sums"])

    wanted = table.select("n", "chunk", *columns)
    parts = sorted((r["chunk"], np.frombuffer(r["sums"]).reshape(-1, m)) for r in wanted.mapInArrow(totals, "chunk int, sums binary").collect())
    before, upto, following = {}, np.zeros((size, m)), np.full(m, np.nan)
    whole = sum(part[:size] + part[size : 2 * size] for _, part in parts)
    for chunk, part in parts:
        before[chunk], upto = [upto], upto + part[:size]
    for chunk, part in reversed(parts):
        before[chunk].append(following)
        following = np.where(np.isnan(part[-2]), following, part[-2])
    shared = table.sparkSession.sparkContext.broadcast((before, whole))  # at most LEVEL_CELLS numbers

    def sweep(batches):
        before, whole = shared.value
        for chunk, (key, label, weight, x, codes) in chunks_of(batches):
            for t, rows, at, w in rows_of_open((key, weight, x, codes), values, growth, tops):
                some = ~np.isnan(x[rows, i])
                rows, at, w = rows[some], at[some], w[some]
                order = np.argsort(at.astype(np.uint16) if len(tops[t].open) < 1 << 16 else at, kind="stable")
                rows, at, w = rows[order], at[order], w[order]
                if not len(at):
                    continue
                v, name = x[rows, i], at + first[t]
                edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                last = np.r_[edge[1:], len(at)] - 1
                after = np.r_[v[1:], np.float32(np.nan)]
                after[last] = before[chunk][1][name[last]]  # the value after the chunk
                ends = np.flatnonzero(after > v)  # rows that may end a left side
                if not len(ends):
                    continue
                to, run = name[ends], np.repeat(np.arange(len(edge)), last - edge + 1)[ends]
                left = []
                for k, own in enumerate(sums.rows(label[rows], w)):
                    total = np.cumsum(own)
                    left.append(total[ends] - (total[edge] - own[edge])[run] + before[chunk][0][k][to])
                left = np.stack(left)
                gain = sums.gain(left, whole[:, to])
                start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                best = np.maximum.reduceat(gain, start)
                hit = np.flatnonzero((gain == np.repeat(best, np.diff(np.r_[start, len(run)]))) & np.isfinite(gain))
                hit = hit[np.r_[True, run[hit][1:] != run[hit][:-1]]] if len(hit) else hit
                cut = between(v[ends[hit]], after[ends[hit]])
                nodes = [tops[t].open[n] for n in at[ends[hit]].tolist()]
                n = len(hit)
                lists = [[t] * n, nodes, [f] * n, [chunk] * n, gain[hit].tolist(), cut.tolist(), [left[:, h].tobytes() for h in hit], [b""] * n]
                yield record(SPLITS, *lists)

    rows = wanted.mapInArrow(sweep, SPLITS_DDL)  # `code` names the chunk here, of equal splits the first one counts
    best = rows.groupBy("tree", "node").agg(F.max_by(F.struct("gain", "cut", "left"), F.struct("gain", -F.col("code"))).alias("s"))
    found = {(r["tree"], r["node"]): r["s"] for r in best.collect()}  # one row per open node
    shared.unpersist()
    out = []
    for t, top in tops.items():
        for k, node in enumerate(top.open):
            s, own = found.get((t, node)), whole[:, first[t] + k]
            out.append((t, node, f, 0, s["gain"], s["cut"], np.frombuffer(s["left"]), own) if s else (t, node, f, 0, -np.inf, 0.0, own, own))
    return out


def chosen_split(splits: list[tuple], node: int, tree: int, width: int, growth: Growth) -> tuple | None:
    """The best split of a node by one of its drawn features; where none of them varies, by the next one that does."""
    varies = sorted((s for s in splits if np.isfinite(s[4])), key=lambda s: s[2])
    if varies and growth.features and growth.features < width:
        rank = feature_ranks(np.array([node]), width, tree, -1, growth.seed)[0]
        varies = [s for s in varies if rank[s[2]] < growth.features] or [min(varies, key=lambda s: rank[s[2]])]
    return max(varies, key=lambda s: s[4]) if varies else None  # of equal ones the first feature


def grow_tops(table: DataFrame, ordered: dict[int, DataFrame], chunks: int, values: list[np.ndarray | None], growth: Growth, tops: dict[int, Top], sums: Sums) -> None:
    """Split nodes of more than SUBTREE_ROWS rows until none is left; `ordered` holds the rows in the order of each feature of many values."""
    width, size = len(values), sums.size
    per_node = max(sum(v is not None for v in values) * 256 * size, chunks * (2 * size + 2) if ordered else 0)
    for top in tops.values():
        top.open, top.slots = [0], []
    while any(top.open for top in tops.values()):
        found: dict[tuple[int, int], list[tuple]] = {}
        group, held = {}, 0
        still = [(t, x) for t, x in tops.items() if x.open]
        for i, (t, x) in enumerate(still):
            group[t], held = x, held + len(x.open) * per_node
            if i + 1 == len(still) or held + len(still[i + 1][1].open) * per_node > LEVEL_CELLS:
                splits = []
                if any(v is not None for v in values):  # one row per open node and feature
                    rows = tallied_splits(table, values, growth, group, sums).collect()
                    splits += [(*r[:6], np.frombuffer(r["left"]), np.frombuffer(r["sums"])) for r in rows]
                for f, own in ordered.items():
                    splits += swept_splits(own, f, values, growth, group, sums)
                for s in splits:
                    found.setdefault(s[:2], []).append(s)
                group, held = {}, 0
        for top in tops.values():
            top.open = []
        for (t, node), splits in sorted(found.items(), key=lambda x: x[0]):
            top, whole = tops[t], splits[0][7]
            own = sums.facts(whole)
            top.facts[node] = (0.0, *own[:3], 0.0, own[3])
            split = chosen_split(splits, node, t, width, growth)
            if split is None or own[2] <= PURE or own[0] < growth.least_split or (growth.depth is not None and top.depth[node] >= growth.depth):
                continue  # a leaf
            if own[0] <= SUBTREE_ROWS:
                top.slots.append(node)  # only a root that was counted for the first time
                continue
            names, parts = [], [sums.facts(split[6]), sums.facts(whole - split[6])]
            for part in parts:
                names.append(len(top.feature))
                top.feature.append(-1)
                top.code.append(0)
                top.left.append(0)
                top.right.append(0)
                top.depth.append(top.depth[node] + 1)
                top.facts.append((0.0, *part[:3], 0.0, part[3]))
                (top.open if part[0] > SUBTREE_ROWS else top.slots).append(names[-1])
            top.feature[node], top.code[node], (top.left[node], top.right[node]) = split[2], split[3], names
            decrease = own[1] * own[2] - sum(p[1] * p[2] for p in parts)
            top.facts[node] = (split[5], *own[:3], decrease, own[3])


# --- node tables ----------------------------------------------------------------------------

#: A row holds a sub-tree, or with slot -1 the nodes above the sub-trees of a tree: a column as the bytes of an array.
#: `gains` is what the splits by each feature take away.
PARTS = pa.schema(
    [("tree", pa.int32()), ("slot", pa.int32()), ("width", pa.int32())]
    + [(c, pa.binary()) for c in ("feature", "threshold", "left", "right", "value", "rows", "weight", "impurity", "decrease", "gains")]
)
PARTS_DDL = "tree int, slot int, width int, " + ", ".join(f"`{c}` binary" for c in PARTS.names[3:])
TYPES = {"feature": np.int32, "left": np.int32, "right": np.int32, "rows": np.int64}
SCORING = ("feature", "threshold", "left", "right", "value")
#: In the table above, the feature of a node that is a sub-tree.
BELOW = -2
NODES_DDL = (
    "tree int, slot int, node int, feature int, threshold double, `left` int, `right` int, `rows` long, weight double, impurity double, "
    "decrease double, value array<double>"
)
NODES = pa.schema(
    [("tree", pa.int32()), ("slot", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int32())]
    + [("right", pa.int32()), ("rows", pa.int64()), ("weight", pa.float64()), ("impurity", pa.float64()), ("decrease", pa.float64())]
    + [("value", pa.list_(pa.float64()))]
)


#: Rows of megabytes: Parquet is to look at its buffers after each.
WRITING = {f"parquet.{what}.size.row.check.{end}": "1" for what in ("block", "page") for end in ("min", "max")}


def part_columns(tree: int, slot: int, grown: dict[str, np.ndarray], width: int, keep: bool) -> list[list]:
    """Without `keep` only the gains."""
    split = grown["feature"] >= 0
    gains = np.bincount(grown["feature"][split], weights=grown["decrease"][split], minlength=width)
    arrays = [np.ascontiguousarray(grown[c], dtype=TYPES.get(c, np.float64)).tobytes() if keep else b"" for c in PARTS.names[3:-1]]
    return [[tree], [slot], [grown["value"].shape[1]], *[[a] for a in arrays], [gains.tobytes()]]


def finished(table: DataFrame, values: list[np.ndarray | None], growth: Growth, tops: dict[int, Top], keep: bool = True) -> DataFrame:
    """The sub-trees, one row each: rows are dealt to (tree, slot), each of which one task finishes."""
    dealt_schema = pa.schema([("tree", pa.int32()), ("slot", pa.int32())] + [(c, pa.binary()) for c in ("label", "weight", "x", "codes")])
    width, (many, few) = len(values), sides_of(values)

    def deal(batches):
        for key, label, weight, x, codes in blocks_of(batches, "key", "label", "weight", "x", "codes"):
            for t, top in tops.items():
                rows, w = draws(key, weight, growth, t)
                if len(top.feature) == 1:
                    pieces = [(0, np.arange(len(rows)))] if top.slots and len(rows) else []
                else:
                    slot = top.places(x[rows], codes[rows], values)
                    order = np.argsort(slot, kind="stable")
                    found, first = np.unique(slot[order], return_index=True)
                    wanted = set(top.slots)
                    pieces = [(int(p), at) for p, at in zip(found, np.split(order, first[1:])) if int(p) in wanted]
                if pieces:
                    columns = [[v.tobytes() for v in (label[rows[at]], w[at], x[rows[at]].T, codes[rows[at]].T)] for _, at in pieces]
                    yield record(dealt_schema, [t] * len(pieces), [p for p, _ in pieces], *map(list, zip(*columns)))

    depths = {(t, s): top.depth[s] for t, top in tops.items() for s in top.slots}

    def finish(group: pa.Table) -> pa.Table:
        t, slot = group.column("tree")[0].as_py(), group.column("slot")[0].as_py()
        y, w = (np.frombuffer(b"".join(group.column(c).to_pylist())) for c in ("label", "weight"))

        def joined(name: str, kind: type, count: int) -> list[np.ndarray]:
            parts = [np.frombuffer(p, kind).reshape(count, -1) for p in group.column(name).to_pylist()] if count else []
            return [np.concatenate([p[i] for p in parts]) for i in range(count)]

        floats, codes = dict(zip(many, joined("x", np.float32, len(many)))), dict(zip(few, joined("codes", np.uint8, len(few))))
        data = Columns([floats[f] if v is None else v[codes[f]] for f, v in enumerate(values)], [codes.get(f) for f in range(width)], values)
        order = data.order(y, w)  # sums do not hang on the order of arrival
        grown = subtree(data.take(order), y[order], w[order], growth, depths[t, slot], t, slot)
        return pa.Table.from_batches([record(PARTS, *part_columns(t, slot, grown, width, keep))])

    groups = max(1, len(depths))
    rows = table.mapInArrow(deal, "tree int, slot int, label binary, weight binary, x binary, codes binary")
    rows = rows.repartition(min(groups, 2000), "tree", "slot")
    return rows.groupBy("tree", "slot").applyInArrow(finish, PARTS_DDL)


def top_parts(spark: SparkSession, tops: dict[int, Top], width: int) -> DataFrame:
    """The nodes above the sub-trees; a child that is a sub-tree is named by its slot as -2 - slot."""
    rows = []
    for t, top in tops.items():
        if len(top.feature) == 1 and top.slots:
            continue
        slots = np.zeros(len(top.feature), dtype=bool)
        slots[top.slots] = True
        feature = np.array(top.feature)
        children = [np.where(feature >= 0, np.where(slots[c], -2 - c, c), 0) for c in (np.array(top.left), np.array(top.right))]
        cut, n, weight, pure, decrease = (np.array(v) for v in zip(*[f[:5] for f in top.facts]))
        size = max(len(f[5]) for f in top.facts)
        value = np.array([[*f[5], *[0.0] * (size - len(f[5]))] for f in top.facts])
        grown = {"feature": np.where(slots, BELOW, feature), "threshold": cut, "left": children[0], "right": children[1], "value": value}
        grown |= {"rows": n, "weight": weight, "impurity": pure, "decrease": decrease}
        rows.append(tuple(c[0] for c in part_columns(t, -1, grown, width, True)))
    return spark.createDataFrame(rows, PARTS_DDL)


# --- the model ------------------------------------------------------------------------------


def unpacked(row: dict, columns=SCORING) -> tuple:
    arrays = [np.frombuffer(row[c], TYPES.get(c, np.float64)) for c in columns]
    return tuple(a.reshape(-1, row["width"]) if c == "value" else a for c, a in zip(columns, arrays))


def reached(x: np.ndarray, tree: tuple) -> np.ndarray:
    """The nodes in which the rows end; -2 - slot for a sub-tree."""
    feature, cut, left, right, _ = tree
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        rows = rows[node[rows] >= 0]
        rows = rows[feature[node[rows]] >= 0]
        if not len(rows):
            return node
        at = node[rows]
        node[rows] = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])


_KEPT: dict[str, list] = {}


def parts_in(path: str):
    """(tree, slot, arrays) of a model's parts, read in a task; kept by the worker, in order, if they are small enough."""
    if path in _KEPT:
        yield from _KEPT[path]
        return
    from pyarrow import fs, parquet

    system, folder = file_system(path)
    files = [i.path for i in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path) if i.path.endswith(".parquet")]

    def read():
        for name in files:
            with system.open_input_file(name) as source:
                for batch in parquet.ParquetFile(source).iter_batches(batch_size=1, columns=["tree", "slot", "width", *SCORING]):
                    for row in batch.to_pylist():
                        yield row["tree"], row["slot"], unpacked(row)

    held, size = [], 0
    parts = read()
    for part in parts:
        held.append(part)
        size += sum(a.nbytes for a in part[2])
        if size > CACHE_BYTES:
            break
    else:
        for other in [p for p in _KEPT if p.rsplit("/", 1)[0] != path.rsplit("/", 1)[0]]:
            del _KEPT[other]  # one model at a time
        _KEPT[path] = sorted(held, key=lambda p: p[:2])
        yield from _KEPT[path]
        return
    yield from held
    del held
    yield from parts


def votes(x: np.ndarray, path: str, trees: int) -> np.ndarray:
    """Sums over the trees of the values of the leaves in which the rows end."""
    ends, total = {}, 0.0
    for tree, _, top in parts_in(f"{path}/tops"):
        node = reached(x, top)
        whole = np.flatnonzero(node >= 0)
        total = total if isinstance(total, np.ndarray) else np.zeros((len(x), top[-1].shape[1]))
        total[whole] += top[-1][node[whole]]
        ends[tree] = np.where(node < 0, -2 - node, -1).astype(np.int32)
    for tree, slot, part in parts_in(f"{path}/parts"):
        total = total if isinstance(total, np.ndarray) else np.zeros((len(x), part[-1].shape[1]))
        if tree not in ends:
            total += part[-1][reached(x, part)]
        elif len(rows := np.flatnonzero(ends[tree] == slot)):
            total[rows] += part[-1][reached(x[rows], part)]
    return total


@dataclass
class NodeForest:
    """A forest in the shared folder: `path`/tops and `path`/parts. Rows are scored where they are, a sub-tree at a time."""

    path: str
    n_classes: int
    trees: int

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PARTS_DDL).parquet(f"{self.path}/tops", f"{self.path}/parts")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: tree, slot, node, feature (-1: leaf), threshold, left, right, rows, weight, impurity, decrease, value."""

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    names = ("feature", "threshold", "left", "right", "rows", "weight", "impurity", "decrease", "value")
                    *arrays, value = unpacked(row, names)
                    for first in range(0, len(value), 50_000):
                        own = np.flatnonzero(arrays[0][first : first + 50_000] > BELOW) + first
                        lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * value.shape[1], value[own].ravel())
                        columns = [np.full(len(own), row["tree"]), np.full(len(own), row["slot"]), own, *[a[own] for a in arrays]]
                        yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, NODES)] + [lists], schema=NODES)

        return self.parts(spark).mapInArrow(run, NODES_DDL)

    def first_levels(self, spark: SparkSession) -> DataFrame:
        """The root of a single tree and its children as nodes 0, 1 and 2, wherever their rows are kept."""
        nodes = self.nodes(spark)
        root = nodes.where("node = 0 AND slot <= 0").orderBy("slot").first()  # slot -1 if the root was too large for one task
        at = {0: (root["slot"], 0)}
        if root["feature"] >= 0:
            at |= {i: (root["slot"], c) if c >= 0 else (-2 - c, 0) for i, c in ((1, root["left"]), (2, root["right"]))}
        number = F.coalesce(*[F.when((F.col("slot") == slot) & (F.col("node") == node), i) for i, (slot, node) in at.items()])
        return nodes.withColumn("node", number).where("node IS NOT NULL")

    def importances(self, spark: SparkSession, features: list[str]) -> DataFrame:
        """(feature, importance): each tree's share of the impurity taken away, averaged over the trees."""
        schema = pa.schema([("tree", pa.int32()), ("feature", pa.int32()), ("d", pa.float64())])

        def run(batches):
            for batch in batches:
                for tree, gains in zip(batch.column("tree").to_pylist(), batch.column("gains").to_pylist()):
                    sums = np.frombuffer(gains)
                    yield record(schema, [tree] * len(sums), range(len(sums)), sums.tolist())

        own = self.parts(spark).select("tree", "gains").mapInArrow(run, "tree int, feature int, d double")
        # summed by size, so that the order of arrival does not matter
        per_tree = own.groupBy("tree", "feature").agg(F.aggregate(F.sort_array(F.collect_list("d")), F.lit(0.0), lambda a, d: a + d).alias("d"))
        total = F.sum("d").over(Window.partitionBy("tree"))
        shares = per_tree.withColumn("share", F.when(total > 0, F.col("d") / total).otherwise(0.0)).groupBy("feature").agg(F.sum("share").alias("s"))
        whole = F.sum("s").over(Window.partitionBy())  # one row per feature
        found = shares.select("feature", F.when(whole > 0, F.col("s") / whole).otherwise(0.0).alias("importance"))
        names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
        return names.join(found, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def _values(self, features: Column) -> Column:
        path, trees = self.path, self.trees
        most = max(1, SCORE_PLACES // max(1, trees))

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, size = [], 0

            def scored():
                found = votes(np.concatenate(held), path, trees) / trees
                for i in range(0, len(found), 10_000):
                    yield pd.Series(list(found[i : i + 10_000]))

            for vectors in batches:
                if not len(vectors):
                    continue
                held.append(np.stack(vectors.to_numpy()).astype(np.float32))
                size += len(vectors)
                if size >= most:  # a forest that is not kept is read once for so many rows
                    yield from scored()
                    held, size = [], 0
            if held:
                yield from scored()

        return score(vector_to_array(features))

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        values = self._values(F.col("features"))
        if not self.n_classes:
            return df.withColumn(f"{prefix}prediction", values[0])
        scored = df.withColumn(f"{prefix}probability", values)
        p = F.col(f"{prefix}probability")
        return scored.withColumn(f"{prefix}prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))

    def save_to(self, path: str) -> None:
        spark = SparkSession.active()
        for part in ("tops", "parts"):
            spark.read.schema(PARTS_DDL).parquet(f"{self.path}/{part}").write.mode("overwrite").options(**WRITING).parquet(f"{path}/{part}")


def fit(train: DataFrame, growth: Growth, path: str, keep: bool = True) -> NodeForest:
    """Grow trees over `features` and `_label` (weighted by `_weight` where present) into node tables below `path`.

    Without `keep` only what `importances` needs of the sub-trees is written, not their nodes.
    Values are compared as 32-bit floats; NaN goes to the right. An empty table is an error.
    """
    spark = train.sparkSession
    first = train.select(vector_to_array("features").alias("v")).first()
    if first is None:
        raise ValueError("no rows to train on")
    width = len(first["v"])
    n, values = few_values(train, width)
    table = staged(row_blocks(train, width, None, values), "forest-rows")
    if table.rdd.getNumPartitions() < (tasks := least_tasks(spark, n)):  # few files: dealt out once, not in every pass
        few, table = table, staged(table.repartition(tasks), "forest-rows")
        dropped(few)
    step = max(1, DEALT_ROWS // n)
    ordered: dict[int, DataFrame] = {}
    try:
        tops = {t: Top() for t in range(growth.trees)}
        if n > SUBTREE_ROWS:  # smaller trees are finished whole by one task each, with the same splits
            chunks = -(-n // CHUNK_ROWS)
            for f in sides_of(values)[0]:
                ordered[f] = staged(row_blocks(train, width, f, values, chunks), "forest-order")
            grow_tops(table, ordered, chunks, values, growth, tops, Sums.of(train, growth.classes))
            dropped(*ordered.values())
            ordered = {}
        top_parts(spark, tops, width).coalesce(1).write.options(**WRITING).parquet(f"{path}/tops")
        for i in range(0, growth.trees, step):
            some = {t: tops[t] for t in range(i, min(growth.trees, i + step))}
            finished(table, values, growth, some, keep).write.mode("append").options(**WRITING).parquet(f"{path}/parts")
    finally:
        dropped(table, *ordered.values())
    return NodeForest(path, growth.classes, growth.trees)
