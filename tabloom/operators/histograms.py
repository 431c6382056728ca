"""Boosted trees grown on histograms: second-order boosting and gradient boosting.

Features are binned once. A round grows one tree per output, all outputs in shared passes, level by
level: tasks add up gradients, Hessians and counts per (output, node, feature, bin) of the rows they
hold. Of two siblings only the smaller is counted; the larger is the parent less the smaller. Where the tasks' cells
are few, their number being checked, the driver adds them and looks for the splits; otherwise Spark merges
them and windows over the merged cells find each node's best split. Gradients are rounded to multiples of a
power of two small enough for exact sums, so both ways, any order of the rows and a recomputed task give the same tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.quantiles import many_quantiles, quantiles
from ..session import dropped, least_tasks, spread, staged

#: Bins of a feature; the last number stands for a missing value.
BINS = 255
MISSING = 255
#: Up to so many rows one aggregate finds the bin edges; above, the same edges come from counted values in order.
EXACT_ROWS = 200_000
#: Values that a task holds while they are put in order.
RANGE_VALUES = 4_000_000
#: Rows with the margins of a round are kept in memory, and written after so many rounds so that plans stay short.
REFRESH = 10
#: Sums of rounded gradients stay below this, where doubles hold whole numbers exactly.
EXACT = 2.0**52
SCORE_CELLS = 1 << 21
#: Rows that make a task of a pass worth its start.
TASK_ROWS = 100_000
#: Histogram cells of all tasks together that the driver takes at once, 24 bytes each.
DRIVER_CELLS = 1 << 22


@dataclass(frozen=True)
class Boost:
    """Settings. `newton`: splits weigh by Hessians with a penalty; otherwise by counts, and only leaves use Hessians."""

    task: str  # "number", "binary" or "classes"
    outputs: int = 1
    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    newton: bool = True
    penalty: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 1e-6


def hist_settings(task: str, outputs: int, **options) -> Boost:
    return Boost(task, outputs, **options)


def gradient_settings(task: str, outputs: int, **options) -> Boost:
    return replace(Boost(task, outputs, rate=0.1, depth=3, newton=False, penalty=0.0, least_weight=0.0), **options)


@dataclass
class Tree:
    """Nodes by number; the root is 0 and a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, blank in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("missing_left", False), ("left", 0), ("right", 0), ("value", 0.0), ("gain", 0.0)):
            getattr(self, name).append(blank)
        return len(self.feature) - 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of bins ends."""
        node = np.zeros(len(bins), dtype=np.int64)
        feature = np.array(self.feature)
        if feature[0] < 0:
            return node
        # the next node by node and bin; a leaf stays where it is, so that all rows go down together
        own = np.arange(len(feature))
        step = np.repeat(own[:, None], 256, 1)
        for i in np.flatnonzero(feature >= 0).tolist():
            step[i] = np.where(np.arange(256) <= self.bin[i], self.left[i], self.right[i])
            step[i, MISSING] = self.left[i] if self.missing_left[i] else self.right[i]
        step, first, flat = step.ravel(), np.maximum(feature, 0), bins.ravel()
        start = np.arange(len(bins)) * bins.shape[1]
        for _ in range(self.height()):
            node = step.take(node * 256 + flat.take(start + first.take(node)))
        return node

    def height(self) -> int:
        depth = [0] * len(self.feature)
        for i, f in enumerate(self.feature):  # children are numbered after their parents
            if f >= 0:
                depth[self.left[i]] = depth[self.right[i]] = depth[i] + 1
        return max(depth)


# --- binned rows ----------------------------------------------------------------------------


def bin_edges(train: DataFrame, width: int, rows: int) -> list[np.ndarray]:
    """Upper ends of the bins but the last, per feature: exact quantiles whatever the number of rows, fewer where values repeat."""
    values = vector_to_array("features")
    names = [f"x{i}" for i in range(width)]
    table = train.select(values.alias("v")).select(*[F.nanvl(F.col("v")[i], F.lit(None)).alias(n) for i, n in enumerate(names)])
    places = [k / BINS for k in range(1, BINS)]
    if rows <= EXACT_ROWS:
        found = quantiles(table, names, places, exact_rows=EXACT_ROWS, rows=rows)
    else:
        found = many_quantiles(table, names, places, max(least_tasks(train.sparkSession, rows), rows * width // RANGE_VALUES))
    return [np.unique(np.array([v for v in found[n] if v is not None], dtype=float)) for n in names]


def binned_values(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(e, x[:, i], side="left"))
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


#: A row of the table holds a whole batch of training rows, a column as the bytes of its values.
ROWS = pa.schema([(c, pa.binary()) for c in ("label", "weight", "bins", "margins")])
ROWS_DDL = "label binary, weight binary, bins binary, margins binary"


def block(label: np.ndarray, weight: np.ndarray, bins: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (label, weight, bins, margins)], schema=ROWS)


def blocks_of(batches, width: int, outputs: int):
    """(label, weight, bins, margins) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            label, weight, bins, margins = (batch.column(c)[i].as_buffer() for c in ROWS.names)
            yield np.frombuffer(label), np.frombuffer(weight), np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(margins).reshape(-1, outputs)


def binned_rows(train: DataFrame, edges: list[np.ndarray], base: list[float]) -> DataFrame:
    weight = F.col("_weight") if "_weight" in train.columns else F.lit(1.0)
    width = len(edges)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "weight"))
                margins = np.tile(np.array(base, dtype=float), (len(label), 1))
                yield block(label, own, binned_values(matrix(batch.column("x"), width), edges), margins)

    rows = train.select(F.col("_label").alias("label"), weight.cast("double").alias("weight"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, ROWS_DDL)


def moved(bins: np.ndarray, margins: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    """Margins after the trees of some rounds."""
    out = margins.copy()
    for trees in pending:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree.value)[tree.places(bins)]
    return out


def slopes(task: str, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss per row and output."""
    if task == "number":
        return margins - label[:, None], np.ones_like(margins)
    if task == "binary":
        p = 1 / (1 + np.exp(-margins))
        return p - label[:, None], p * (1 - p)
    e = np.exp(margins - margins.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (label[:, None] == np.arange(margins.shape[1])), p * (1 - p)


def refreshed(table: DataFrame, width: int, outputs: int, pending: list[list[Tree]]) -> DataFrame:
    def run(batches):
        for label, weight, bins, margins in blocks_of(batches, width, outputs):
            yield block(label, weight, bins, moved(bins, margins, pending))

    return table.mapInArrow(run, ROWS_DDL)


# --- histograms -----------------------------------------------------------------------------

CELL = ["unit", "node", "feature", "bin"]
CELLS = pa.schema([(c, pa.int32()) for c in CELL] + [(c, pa.float64()) for c in "ghn"])
CELLS_DDL = "unit int, node int, feature int, bin int, g double, h double, n double"


def cells(table: DataFrame, width: int, settings: Boost, pending: list[list[Tree]], partial: list[Tree], counted: list[list[int]], scale: float) -> DataFrame:
    """Rounded sums per (unit, node, feature, bin) of each task's rows, for the nodes to be counted of every unit's tree."""

    def run(batches):
        sums = [np.zeros((3, len(nodes) * width * 256)) for nodes in counted]
        slot = []
        for tree, nodes in zip(partial, counted):
            at = np.full(len(tree.feature), -1)
            at[nodes] = np.arange(len(nodes))
            slot.append(at)
        for label, weight, bins, margins in blocks_of(batches, width, settings.outputs):
            g, h = slopes(settings.task, moved(bins, margins, pending), label)
            for k, tree in enumerate(partial):
                if not counted[k]:
                    continue
                at = slot[k][tree.places(bins)]
                here = at >= 0
                values = [np.rint(v[here] * scale) for v in (g[:, k] * weight, h[:, k] * weight, weight)]
                first = at[here] * (width * 256)
                for f in range(width):
                    cell = first + f * 256 + bins[here, f]
                    for s, v in zip(sums[k], values):
                        s += np.bincount(cell, weights=v, minlength=len(s))
        for k, nodes in enumerate(counted):
            used = np.flatnonzero(sums[k][2])
            named = [np.full(len(used), k), np.array(nodes, dtype=int)[used // (width * 256)], used // 256 % width, used % 256]
            columns = [pa.array(c.astype(np.int32)) for c in named] + [pa.array(s[used]) for s in sums[k]]
            yield pa.RecordBatch.from_arrays(columns, schema=CELLS)

    return table.mapInArrow(run, CELLS_DDL)


def merged(df: DataFrame) -> DataFrame:
    return df.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in "ghn"])


def with_siblings(spark: SparkSession, small: DataFrame, parents: DataFrame, pairs: list[tuple[int, int, int, int]]) -> DataFrame:
    """The cells of the counted nodes and of their siblings; pairs: (unit, parent, counted node, its sibling)."""
    names = F.broadcast(spark.createDataFrame(pairs, "unit int, parent int, node int, sibling int"))  # at most 2^depth rows
    keep = ["feature", "bin", "g", "h", "n"]
    less = small.join(names, ["unit", "node"]).select("unit", F.col("sibling").alias("node"), *keep[:2], *[(-F.col(c)).alias(c) for c in "ghn"])
    whole = parents.withColumnRenamed("node", "parent").join(names, ["unit", "parent"]).select("unit", F.col("sibling").alias("node"), *keep)
    return merged(small.unionByName(less).unionByName(whole)).where("n > 0")


def candidate_splits(level: DataFrame, settings: Boost, scale: float) -> DataFrame:
    """Every split between bins with its gain, missing values on either side; `left` sums go with the smaller bins."""
    group = Window.partitionBy("unit", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    df = level.select(*CELL, *[(F.col(c) / scale).alias(c) for c in "ghn"])
    for c in "ghn":
        df = df.withColumn(f"all_{c}", F.sum(c).over(group))
        df = df.withColumn(f"missing_{c}", F.sum(F.when(F.col("bin") == MISSING, F.col(c)).otherwise(0.0)).over(group))
        df = df.withColumn(f"upto_{c}", F.sum(c).over(upto))
    sides = F.array(
        F.struct(F.lit(False).alias("missing_left"), *[F.col(f"upto_{c}").alias(f"left_{c}") for c in "ghn"]),
        F.struct(F.lit(True).alias("missing_left"), *[(F.col(f"upto_{c}") + F.col(f"missing_{c}")).alias(f"left_{c}") for c in "ghn"]),
    )
    df = df.select(*CELL, "missing_n", *[f"all_{c}" for c in "ghn"], F.inline(sides))
    by = "h" if settings.newton else "n"
    left, both = F.col(f"left_{by}") + settings.penalty, F.col(f"all_{by}") + settings.penalty
    right = both - F.col(f"left_{by}")
    rest = F.col("all_g") - F.col("left_g")
    gain = F.col("left_g") * F.col("left_g") / left + rest * rest / right - F.col("all_g") * F.col("all_g") / both
    fits = (
        (F.col("bin") < MISSING) & (F.col("left_n") > 0) & (F.col("left_n") < F.col("all_n"))
        & (~F.col("missing_left") | (F.col("missing_n") > 0))
        & (F.col(f"left_{by}") >= settings.least_weight) & (F.col(f"all_{by}") - F.col(f"left_{by}") >= settings.least_weight)
    )
    return df.withColumn("gain", F.when(fits, gain))


def best_splits(candidates: DataFrame) -> DataFrame:
    """One row per node: its sums and its best split, of equal ones the first feature and bin."""
    order = F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("feature"), -F.col("bin"), ~F.col("missing_left")))
    split = F.max_by(F.struct("feature", "bin", "missing_left", "left_g", "left_h", "left_n", "gain"), order).alias("split")
    return candidates.groupBy("unit", "node").agg(*[F.max(f"all_{c}").alias(f"all_{c}") for c in "ghn"], split)


def leaf(settings: Boost, g: float, h: float) -> float:
    below = h + settings.penalty
    share = (settings.outputs - 1) / settings.outputs if settings.task == "classes" and not settings.newton else 1.0
    return -settings.rate * share * g / below if below > 1e-12 else 0.0


@dataclass
class Found:
    """The sums of a node and its best split, if it has any."""

    unit: int
    node: int
    sums: tuple[float, float, float]
    split: tuple[int, int, bool, float, float, float, float] | None  # feature, bin, missing left, left sums, gain


class SparkLevels:
    """Levels whose cells are merged, subtracted and searched by Spark."""

    def __init__(self, settings: Boost, scale: float, width: int):
        self.settings, self.scale, self.parents = settings, scale, None

    def search(self, found: DataFrame, counted: list[list[int]], pairs: list[tuple[int, int, int, int]]) -> list[Found]:
        small = merged(found)
        level = small if self.parents is None else with_siblings(found.sparkSession, small, self.parents, pairs)
        level = level.persist()
        rows = best_splits(candidate_splits(level, self.settings, self.scale)).collect()  # at most 2^depth rows per output
        self.close()
        self.parents = level
        return [Found(r["unit"], r["node"], (r["all_g"], r["all_h"], r["all_n"]), tuple(r["split"]) if r["split"] else None) for r in rows]

    def close(self) -> None:
        if self.parents is not None:
            self.parents.unpersist()


class DriverLevels:
    """Levels whose cells, of a checked number, come to the driver."""

    def __init__(self, settings: Boost, scale: float, width: int):
        self.settings, self.scale, self.width = settings, scale, width
        self.sums: dict[tuple[int, int], np.ndarray] = {}  # (unit, node): feature x bin x (g, h, n)

    def search(self, found: DataFrame, counted: list[list[int]], pairs: list[tuple[int, int, int, int]]) -> list[Found]:
        table = found.toArrow()
        unit, node, feature, bin_ = (table.column(c).to_numpy() for c in CELL)
        level = {(k, i): np.zeros((self.width, 256, 3)) for k, nodes in enumerate(counted) for i in nodes}
        number = {name: i for i, name in enumerate(level)}
        numbers = np.zeros((len(counted), max((i for _, i in number), default=0) + 1), dtype=np.int64)
        for (k, i), n in number.items():
            numbers[k, i] = n
        at = numbers[unit, node]
        place = (at * self.width + feature) * 256 + bin_
        for c, name in enumerate("ghn"):
            total = np.bincount(place, weights=table.column(name).to_numpy(), minlength=len(level) * self.width * 256)
            for i, cells_ in enumerate(level.values()):
                cells_[:, :, c] = total.reshape(len(level), self.width, 256)[i]
        for k, parent, smaller, larger in pairs:
            level[k, larger] = self.sums[k, parent] - level[k, smaller]
        self.sums = level
        return [self._best(k, i, cells_ / self.scale) for (k, i), cells_ in level.items()]

    def _best(self, unit: int, node: int, cells_: np.ndarray) -> Found:
        """As candidate_splits and best_splits: of equal gains the first feature, bin and missing values to the right."""
        settings, by = self.settings, 1 if self.settings.newton else 2
        whole = cells_[0].sum(0)
        missing = cells_[:, MISSING]
        upto = np.cumsum(cells_[:, :MISSING], axis=1)
        left = np.stack([upto, upto + missing[:, None]], 2)  # feature x bin x side x sums
        below, above = left[..., by], whole[by] - left[..., by]
        fits = (left[..., 2] > 0) & (left[..., 2] < whole[2]) & (below >= settings.least_weight) & (above >= settings.least_weight)
        fits &= (cells_[:, :MISSING, 2] > 0)[:, :, None]  # empty bins repeat the split before them
        fits[:, :, 1] &= (missing[:, 2] > 0)[:, None]
        both = whole[by] + settings.penalty
        with np.errstate(divide="ignore", invalid="ignore"):
            right = both - below
            gain = left[..., 0] * left[..., 0] / (below + settings.penalty) + (whole[0] - left[..., 0]) ** 2 / right - whole[0] * whole[0] / both
        gain = np.where(fits, gain, -np.inf)
        best = int(gain.argmax())
        if not np.isfinite(gain.flat[best]):
            return Found(unit, node, tuple(whole), None)
        f, b, side = np.unravel_index(best, gain.shape)
        return Found(unit, node, tuple(whole), (int(f), int(b), bool(side), *left[f, b, side].tolist(), float(gain[f, b, side])))

    def close(self) -> None:
        self.sums = {}


def grow(table: DataFrame, tasks: int, edges: list[np.ndarray], settings: Boost, pending: list[list[Tree]], scale: float) -> list[Tree]:
    """The trees of one round over rows in `tasks` partitions."""
    units, width = range(settings.outputs), len(edges)
    trees = [Tree() for _ in units]
    counted: list[list[int]] = [[0] for _ in units]
    pairs: list[tuple[int, int, int, int]] = []
    most = tasks * settings.outputs * max(1, 2**settings.depth // 4) * width * 256
    levels = (DriverLevels if most <= DRIVER_CELLS else SparkLevels)(settings, scale, width)
    for _ in range(settings.depth):
        found = levels.search(cells(table, width, settings, pending, trees, counted, scale), counted, pairs)
        counted, pairs = [[] for _ in units], []
        for r in sorted(found, key=lambda r: (r.unit, r.node)):
            k, node, tree = r.unit, r.node, trees[r.unit]
            if not node:
                tree.value[0] = leaf(settings, *r.sums[:2])
            if r.split is None or r.split[-1] <= settings.least_gain:
                continue
            f, b, missing_left, g, h, n, gain = r.split
            left, right = tree.add(), tree.add()
            tree.feature[node], tree.bin[node], tree.missing_left[node] = f, b, missing_left
            tree.threshold[node] = float(edges[f][b]) if b < len(edges[f]) else math.inf
            tree.left[node], tree.right[node], tree.gain[node] = left, right, gain
            tree.value[left] = leaf(settings, g, h)
            tree.value[right] = leaf(settings, r.sums[0] - g, r.sums[1] - h)
            smaller, larger = (left, right) if 2 * n <= r.sums[2] else (right, left)
            counted[k].append(smaller)
            pairs.append((k, node, smaller, larger))
        if not pairs:
            break
    levels.close()
    return trees


def start(train: DataFrame, settings: Boost) -> tuple[int, float, list[float]]:
    """Number of rows, the largest weighted gradient to expect, and the margins before the first round."""
    weight = F.col("_weight") if "_weight" in train.columns else F.lit(1.0)
    shares = [F.sum(F.when(F.col("_label") == k, weight).otherwise(0.0)).alias(f"c{k}") for k in range(max(2, settings.outputs))]
    r = train.agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"), F.max(weight).alias("top"), F.sum(weight * F.col("_label")).alias("y"),
        F.min("_label").alias("low"), F.max("_label").alias("high"), *shares,
    ).first()
    if not r["n"]:
        raise ValueError("no rows to train on")
    if settings.task == "number":
        mean = r["y"] / r["w"]
        return r["n"], 2 * r["top"] * max(r["high"] - mean, mean - r["low"], 1e-9), [mean]
    parts = [max(r[f"c{k}"] / r["w"], 1e-9) for k in range(max(2, settings.outputs))]
    if settings.task == "binary":
        return r["n"], r["top"], [math.log(parts[1] / parts[0])]
    return r["n"], r["top"], [0.0] * settings.outputs if settings.newton else [math.log(p) for p in parts]


def fit(train: DataFrame, settings: Boost) -> "HistModel":
    """Boosted trees over `features` and `_label` (weighted by `_weight` where present).

    NaN features count as missing and go to the side that gains more. Every pass reads all rows.
    """
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    n, largest, base = start(train, settings)
    scale = 2.0 ** math.floor(math.log2(EXACT / (n * max(largest, 1.0))))
    edges = bin_edges(train, width, n)
    stored = staged(binned_rows(train, edges, base), "boost-rows")
    table, before = spread(stored, n, TASK_ROWS).persist(), None
    rounds = []
    try:
        tasks = table.rdd.getNumPartitions()
        for turn in range(settings.rounds):
            trees = grow(table, tasks, edges, settings, [], scale)
            rounds.append(trees)
            if before is not None:  # the table is in memory now
                before.unpersist()
            before = None
            if all(len(t.feature) == 1 and abs(t.value[0]) < 1e-12 for t in trees):
                break
            if turn + 1 == settings.rounds:
                break
            moved_on = refreshed(table, width, settings.outputs, [trees])
            if (turn + 1) % REFRESH:
                before, table = table, moved_on.persist()
                continue
            fresh = staged(moved_on, "boost-rows")
            table.unpersist()
            dropped(stored)
            stored = fresh
            table = spread(stored, n, TASK_ROWS).persist()
    finally:
        table.unpersist()
        if before is not None:
            before.unpersist()
        dropped(stored)
    return HistModel.of(rounds, base, settings)


def gain_table(train: DataFrame, settings: Boost) -> DataFrame:
    """(round, unit, feature, bin, missing_left, gain) of every split of the roots of each round; `bin` is the last on the left."""
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    n, largest, base = start(train, settings)
    scale = 2.0 ** math.floor(math.log2(EXACT / (n * max(largest, 1.0))))
    edges = bin_edges(train, width, n)
    table = staged(binned_rows(train, edges, base), "boost-rows")
    out, pending = [], []
    for turn in range(settings.rounds):
        roots = cells(table, width, settings, pending, [Tree() for _ in range(settings.outputs)], [[0]] * settings.outputs, scale)
        gains = candidate_splits(merged(roots), settings, scale).where("gain IS NOT NULL")
        out.append(gains.select(F.lit(turn).alias("round"), "unit", "feature", "bin", "missing_left", "gain"))
        pending = [*pending, grow(table, table.rdd.getNumPartitions(), edges, settings, pending, scale)]
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


# --- scoring --------------------------------------------------------------------------------


@dataclass
class HistModel:
    """The trees of all rounds as arrays of nodes; children are numbered over all trees."""

    task: str
    base: list[float]
    roots: list[int]
    units: list[int]
    feature: list[int]
    threshold: list[float]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]
    _shared: object = field(default=None, repr=False, compare=False)

    @staticmethod
    def of(rounds: list[list[Tree]], base: list[float], settings: Boost) -> "HistModel":
        out = HistModel(settings.task, list(base), [], [], [], [], [], [], [], [], [])
        for trees in rounds:
            for k, t in enumerate(trees):
                first = len(out.feature)
                out.roots.append(first)
                out.units.append(k)
                out.feature += t.feature
                out.threshold += t.threshold
                out.missing_left += t.missing_left
                out.left += [first + i for i in t.left]
                out.right += [first + i for i in t.right]
                out.value += t.value
                out.gain += t.gain
        return out

    def margins(self, features: Column) -> Column:
        if self._shared is None:
            arrays = {k: np.array(getattr(self, k)) for k in ("base", "roots", "units", "feature", "threshold", "missing_left", "left", "right", "value")}
            self._shared = SparkSession.active().sparkContext.broadcast(arrays)  # nodes: rounds x outputs x 2^(depth + 1) at most
        shared = self._shared

        @F.pandas_udf("array<double>")
        def score(vectors: pd.Series) -> pd.Series:
            m = shared.value
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))
            out = np.tile(m["base"].astype(float), (len(x), 1))
            step = max(1, SCORE_CELLS // max(1, len(m["roots"])))
            for i in range(0, len(x), step):
                part = x[i : i + step]
                node = np.tile(m["roots"], (len(part), 1))
                rows = np.arange(len(part))[:, None]
                while True:
                    f = m["feature"][node]
                    if (f < 0).all():
                        break
                    v = part[rows, np.maximum(f, 0)]
                    goes = np.where(np.isnan(v), m["missing_left"][node], v <= m["threshold"][node])
                    node = np.where(f < 0, node, np.where(goes, m["left"][node], m["right"][node]))
                got = m["value"][node]
                for k in range(out.shape[1]):
                    out[i : i + step, k] += got[:, m["units"] == k].sum(1)
            return pd.Series(list(out))

        return score(vector_to_array(features))

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        scored = df.withColumn("_margins", self.margins(F.col("features")))
        m = F.col("_margins")
        if self.task == "number":
            return scored.withColumn(f"{prefix}prediction", m[0]).drop("_margins")
        if self.task == "binary":
            p = 1 / (1 + F.exp(-m[0]))
            probability = F.array(1 - p, p)
        else:
            e = F.transform(m, lambda x: F.exp(x - F.array_max(m)))
            probability = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        scored = scored.withColumn(f"{prefix}probability", probability).drop("_margins")
        best = F.array_position(F.col(f"{prefix}probability"), F.array_max(F.col(f"{prefix}probability"))) - 1
        return scored.withColumn(f"{prefix}prediction", best.cast("double"))

    def facts(self) -> dict:
        names = ("task", "base", "roots", "units", "feature", "threshold", "missing_left", "left", "right", "value", "gain")
        return {"kind": "hist", **{k: getattr(self, k) for k in names}}

    @staticmethod
    def from_facts(facts: dict) -> "HistModel":
        return HistModel(**{k: v for k, v in facts.items() if k != "kind"})
