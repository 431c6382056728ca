"""Exact k nearest neighbours between two tables of vectors.

A base table within a checked size is broadcast and every query batch meets it in one Arrow call.
A larger one is cut into cells around pivot rows. Each query first searches the cell it falls
into, which bounds its k-th distance; the triangle inequality and the box around each cell then rule out every cell that
cannot hold anything nearer, and only the rest is visited, for rows within that bound. Cells and query groups are salted to a
bounded size, each task emits at most k rows per query, and nothing is approximated or left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import q

BROADCAST_BYTES = 64 * 1024 * 1024
CELL_ROWS = 20_000
#: Vectors of at most so many numbers are searched by boxes, down to leaves of so many rows.
TREE_WIDTH = 7
LEAF_ROWS = 32
#: Queries, and pairs of a query and a leaf, that are searched at once; cells of a table of distances.
SEARCHED = 1 << 13
DENSE_CELLS = 1 << 21
#: Rows that a task gathers from its batches before it searches.
GATHERED = 50_000
MAX_PIVOTS = 1024
OUT = "query_id {id}, neighbour_id {base_id}, distance double"


def nearest(queries: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int, own_ids=None, within=None):
    """Row index, base id and distance of the k nearest base rows, ties by base id."""
    return Index.of(base, base_ids, k).nearest(queries, k, own_ids, within)


@dataclass
class Index:
    """Base rows in the order of their ids; short vectors also as boxes that are halved down to leaves of a few rows.

    A search takes the leaf a query falls into, which bounds its k-th distance, and then the leaves whose boxes are
    within it, nearest first, as what they hold lowers the bound. Long vectors, or those with values that are not finite, meet every row.
    """

    rows: np.ndarray
    ids: np.ndarray
    cuts: list[tuple[np.ndarray, np.ndarray]] | None = None  # per level the nodes' dimension and value
    boxes: list[tuple[np.ndarray, np.ndarray]] | None = None  # per level the nodes' least and largest values
    leaves: np.ndarray | None = None  # leaf x place: row, or -1

    @staticmethod
    def of(base: np.ndarray, ids: np.ndarray, k: int) -> "Index":
        order = np.argsort(ids, kind="stable")
        rows, ids = np.ascontiguousarray(base[order]), ids[order]
        if not 1 <= rows.shape[1] <= TREE_WIDTH or len(rows) <= 4 * LEAF_ROWS or not np.isfinite(rows).all():
            return Index(rows, ids)
        at = copies_needed(rows, ids, k)
        most = max(LEAF_ROWS, 2 * k + 2)
        depth = max(0, int(np.ceil(np.log2(len(at) / most))))
        cuts = []
        for level in range(depth):
            ends = np.arange(2**level + 1) * len(at) // 2**level
            held, node = np.diff(ends), np.repeat(np.arange(2**level), np.diff(ends))
            # the mean distance from the mean: a few far values would keep the range of a dimension the widest
            middle = np.add.reduceat(rows[at], ends[:-1]) / held[:, None]
            dim = (np.add.reduceat(np.abs(rows[at] - middle[node]), ends[:-1]) / held[:, None]).argmax(1)
            at = at[np.lexsort((rows[at, dim[node]], node))]
            cuts.append((dim, rows[at[(np.arange(2**level) * 2 + 1) * len(at) // 2 ** (level + 1)], dim]))
        ends = np.arange(2**depth + 1) * len(at) // 2**depth
        boxes = [(np.minimum.reduceat(rows[at], ends[:-1]), np.maximum.reduceat(rows[at], ends[:-1]))]
        for _ in range(depth):
            low, high = boxes[0]
            boxes.insert(0, (np.minimum(low[0::2], low[1::2]), np.maximum(high[0::2], high[1::2])))
        leaves = np.full((2**depth, int(np.diff(ends).max())), -1)
        node = np.repeat(np.arange(2**depth), np.diff(ends))
        leaves[node, np.arange(len(at)) - ends[node]] = at
        return Index(rows, ids, cuts, boxes, leaves)

    def nearest(self, queries: np.ndarray, k: int, own_ids=None, within=None):
        """Row index, base id and distance of the k nearest rows; farther ones than `within`, a distance per query, may be left out."""
        if not len(queries) or not len(self.rows):
            return np.array([], int), self.ids[:0], np.array([], float)
        by_boxes = self.leaves is not None and np.isfinite(queries).all()
        step = SEARCHED if by_boxes else max(1, DENSE_CELLS // len(self.rows))
        found = []
        for start in range(0, len(queries), step):
            own = None if own_ids is None else own_ids[start : start + step]
            part = queries[start : start + step]
            most = np.full(len(part), np.inf) if within is None else (within[start : start + step] * (1 + 1e-9) + 1e-12) ** 2
            r, c, d = self._by_boxes(part, k, own, most) if by_boxes else self._dense(part, k, own)
            if within is not None:
                near = d <= most[r]
                r, c, d = r[near], c[near], d[near]
            best = np.lexsort((c, d, r))
            r, c, d = r[best], c[best], d[best]
            keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(part)))[r] < k
            found.append((r[keep] + start, c[keep], np.sqrt(d[keep])))
        rows, cols, dists = (np.concatenate(v) for v in zip(*found))
        return rows, self.ids[cols], dists

    def _dense(self, part: np.ndarray, k: int, own):
        """A matrix product finds the candidates up to its rounding error; their distances are then
        computed directly, so equal rows tie exactly whatever the batch shape."""
        norms, own_norms = (self.rows * self.rows).sum(axis=1), (part * part).sum(axis=1)
        rough = part @ self.rows.T
        rough *= -2.0
        rough += own_norms[:, None]
        rough += norms[None, :]
        if own is not None:
            rough[own[:, None] == self.ids[None, :]] = np.inf
        kth = np.partition(rough, min(k, len(norms)) - 1, axis=1)[:, min(k, len(norms)) - 1]
        slack = 1e-10 * (own_norms + norms.max() + 1.0)
        r, c = np.nonzero((rough <= (kth + slack)[:, None]) & np.isfinite(rough))
        gaps = part[r] - self.rows[c]
        return r, c, (gaps * gaps).sum(axis=1)

    def _gaps(self, part: np.ndarray, of: np.ndarray, leaf: np.ndarray, own) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the leaves and squared distances, infinite where there is no row or it is the query's own."""
        at = self.leaves[leaf]
        d = np.zeros(at.shape)
        for j in range(part.shape[1]):
            gap = part[of, j][:, None] - self.rows[at, j]
            d += gap * gap
        d[at < 0] = np.inf
        if own is not None:
            d[own[of][:, None] == self.ids[at]] = np.inf
        return at, d

    def _by_boxes(self, part: np.ndarray, k: int, own, most: np.ndarray):
        everyone = np.arange(len(part))
        home = np.zeros(len(part), dtype=np.int64)
        for dim, value in self.cuts:
            home = 2 * home + (part[everyone, dim[home]] >= value[home])
        d = self._gaps(part, everyone, home, own)[1]
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= d.shape[1] else np.full(len(part), np.inf)
        limit = np.minimum(limit, most)
        reach = limit * (1 + 1e-9) + 1e-300
        of, node, bound, level = everyone, np.zeros(len(part), dtype=np.int64), np.zeros(len(part)), 0
        while level < len(self.cuts):
            down = min(3, len(self.cuts) - level)
            of, node = np.repeat(of, 2**down), (node[:, None] * 2**down + np.arange(2**down)).ravel()
            level += down
            low, high = self.boxes[level]
            bound = np.zeros(len(of))
            for j in range(part.shape[1]):
                v = part[of, j]
                gap = np.maximum(np.maximum(low[node, j] - v, v - high[node, j]), 0.0)
                bound += gap * gap
            near = bound <= reach[of]
            of, node, bound = of[near], node[near], bound[near]
        # each query's leaves by distance, a few at a time: what was found bounds the rest
        order = np.lexsort((bound, of))
        of, node, bound = of[order], node[order], bound[order]
        place = np.arange(len(of)) - np.searchsorted(of, everyone)[of]
        best = (np.array([], int), np.array([], int), np.array([], float))
        first, size = 0, 2
        while len(of):
            turn = place < first + size
            found = [best]
            for i in range(0, int(turn.sum()), SEARCHED):
                q_, at_leaf = of[turn][i : i + SEARCHED], node[turn][i : i + SEARCHED]
                at, d = self._gaps(part, q_, at_leaf, own)
                r, c = np.nonzero((d <= limit[q_][:, None]) & np.isfinite(d))
                found.append((q_[r], at[r, c], d[r, c]))
            r, c, d = (np.concatenate(v) for v in zip(*found))
            by = np.lexsort((c, d, r))
            r, c, d = r[by], c[by], d[by]
            rank = np.arange(len(r)) - np.searchsorted(r, everyone)[r]
            best = (r[rank < k], c[rank < k], d[rank < k])
            limit[r[rank == k - 1]] = d[rank == k - 1]
            left = ~turn & (bound <= (limit * (1 + 1e-9) + 1e-300)[of])
            of, node, bound, place = of[left], node[left], bound[left], place[left]
            first, size = first + size, size * 2
        return best


def copies_needed(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows, in order, that can be among k neighbours: of equal vectors those with the smallest ids,
    k of them beside as many as any one id has, since a query may leave out its own."""
    order = np.lexsort(rows.T)
    new = np.r_[True, (rows[order][1:] != rows[order][:-1]).any(1)]
    new_id = new | np.r_[True, ids[order][1:] != ids[order][:-1]]
    group = np.cumsum(new) - 1
    ends = np.flatnonzero(np.r_[new_id[1:], True])
    runs = np.diff(np.r_[-1, ends])
    longest = np.zeros(group[-1] + 1, dtype=np.int64)
    np.maximum.at(longest, group[ends], runs)
    place = np.arange(len(order)) - np.flatnonzero(new)[group]
    return np.sort(order[place < k + longest[group]])


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vector_col: str = "vector",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, neighbour_id, distance) for every query row; vectors are arrays."""
    left = queries.select(q(id_col).alias("id"), q(vector_col).cast("array<double>").alias("v"))
    right = base.select(q(id_col).alias("id"), q(vector_col).cast("array<double>").alias("v"))
    facts = right.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if facts["n"] * (facts["d"] or 1) * 8 <= broadcast_bytes:
        found = _by_broadcast(left, right, k, exclude_self)
    else:
        found = _by_cells(left, right, k, exclude_self, facts["n"], cell_rows)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "neighbour_id", "distance")
    )


def _schema(left: DataFrame, right: DataFrame) -> str:
    kind = left.schema["id"].dataType.simpleString()
    return OUT.format(id=kind, base_id=right.schema["id"].dataType.simpleString())


def gathered(batches: Iterator[pd.DataFrame], rows: int = GATHERED) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def collected(df: DataFrame, vector: str) -> tuple:
    """A small table's columns and its vectors as a matrix."""
    table = df.toArrow()
    column = table.column(vector).combine_chunks()
    if not len(column):
        return table, np.empty((0, 1))
    width = len(column[0])
    if column.null_count or set(column.value_lengths().unique().to_pylist()) != {width}:
        raise ValueError("all vectors must be of one length")
    return table, column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)  # a missing number is NaN


def _by_broadcast(left: DataFrame, right: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    table, vectors = collected(right, "v")
    shared = left.sparkSession.sparkContext.broadcast(Index.of(vectors, table.column("id").to_pandas().to_numpy(), k))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in gathered(batches):
            if not len(batch) or not len(index.rows):
                continue
            own = batch["id"].to_numpy()
            r, n, d = index.nearest(stack(batch["v"]), k, own if exclude_self else None)
            yield pd.DataFrame({"query_id": own[r], "neighbour_id": n, "distance": d})

    return left.mapInPandas(search, _schema(left, right))


def _by_cells(
    left: DataFrame, right: DataFrame, k: int, exclude_self: bool, n: int, cell_rows: int
) -> DataFrame:
    spark = left.sparkSession
    wanted = int(min(MAX_PIVOTS, max(2, n // cell_rows + 1)))
    pivots = stack(right.orderBy(F.md5(q("id").cast("string"))).limit(wanted).toPandas()["v"])
    shared = spark.sparkContext.broadcast(pivots)
    id_type = left.schema["id"].dataType.simpleString()
    base_id_type = right.schema["id"].dataType.simpleString()

    def to_pivots(vectors: np.ndarray) -> np.ndarray:
        centres = shared.value
        out = np.empty((len(vectors), len(centres)))
        for j, centre in enumerate(centres):
            gaps = vectors - centre
            out[:, j] = np.sqrt((gaps * gaps).sum(axis=1))
        return out

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                reach = to_pivots(stack(batch["v"]))
                cell = reach.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), reach=reach[np.arange(len(batch)), cell])

    celled = right.mapInPandas(assign, f"id {base_id_type}, v array<double>, cell int, reach double").persist()
    asked = left.mapInPandas(assign, f"id {id_type}, v array<double>, cell int, reach double").persist()
    # one row per pivot
    ends = [f(F.col("v")[j]) for f in (F.min, F.max) for j in range(pivots.shape[1])]
    cells = {
        r["cell"]: (r["n"], r["near"], r["far"], r["ends"])
        for r in celled.groupBy("cell")
        .agg(F.count("*").alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"), F.array(*ends).alias("ends"))
        .collect()
    }
    blocks = {c: -(-size // cell_rows) for c, (size, _, _, _) in cells.items()}
    first = _search_cells(asked.select("id", "v", "cell", F.lit(None).cast("double").alias("limit")), celled, blocks, k, exclude_self, cell_rows)
    first = first.persist()
    limits = first.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.sort_array(F.collect_list("distance"))[k - 1]).alias("limit")
    )
    # a home cell yields at most k rows per block of that cell for each query

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sorted(cells)
        near = np.array([cells[c][1] for c in known])
        far = np.array([cells[c][2] for c in known])
        low, high = np.array([cells[c][3] for c in known], dtype=float).reshape(len(known), 2, -1).transpose(1, 0, 2)
        for batch in batches:
            if not len(batch):
                continue
            vectors = stack(batch["v"])
            reach = to_pivots(vectors)[:, known]
            bound = np.maximum(reach - far[None, :], near[None, :] - reach)
            for j in range(len(known)):  # the box around a cell; what cannot be compared rules nothing out
                gaps = np.maximum(np.maximum(low[j] - vectors, vectors - high[j]), 0.0)
                bound[:, j] = np.fmax(bound[:, j], np.sqrt((gaps * gaps).sum(axis=1)))
            limit = batch["limit"].fillna(np.inf).to_numpy()
            open_ = bound <= (limit * (1 + 1e-9) + 1e-9)[:, None]
            open_ &= batch["cell"].to_numpy()[:, None] != np.array(known)[None, :]
            r, c = np.nonzero(open_)
            yield pd.DataFrame(
                {"id": batch["id"].to_numpy()[r], "v": batch["v"].to_numpy()[r], "cell": np.array(known, "int32")[c], "limit": limit[r]}
            )

    onward = (
        asked.join(limits, q("id") == F.col("query_id"), "left")
        .select("id", "v", "cell", "limit")
        .mapInPandas(others, f"id {id_type}, v array<double>, cell int, limit double")
    )
    second = _search_cells(onward, celled, blocks, k, exclude_self, cell_rows)
    return first.unionByName(second)


def _search_cells(
    visits: DataFrame, celled: DataFrame, blocks: dict[int, int], k: int, exclude_self: bool, cell_rows: int
) -> DataFrame:
    """Search each visited cell; (cell, block, query group) tasks are bounded on both sides."""
    visits = visits.persist()
    load = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    load = {c: n for c, n in load.items() if c in blocks}
    groups = {c: -(-n // cell_rows) for c, n in load.items()}

    def lookup(table: dict[int, int]):
        pairs = [x for c, v in table.items() for x in (F.lit(c), F.lit(v))]
        return F.coalesce(F.create_map(*pairs)[F.col("cell")], F.lit(0)) if pairs else F.lit(0)

    def upto(n):
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    salt = F.xxhash64(q("id").cast("string"))
    queries = visits.select(
        "id", "v", "cell", "limit", F.pmod(salt, F.greatest(lookup(groups), F.lit(1))).cast("int").alias("part"),
        upto(lookup(blocks)).alias("block"),
    )
    bases = celled.select(
        "id", "v", "cell", F.pmod(salt, F.greatest(lookup(blocks), F.lit(1))).cast("int").alias("block"),
        upto(lookup(groups)).alias("part"),
    )
    schema = _schema(queries, bases)

    def search(own: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(base):
            return pd.DataFrame({"query_id": own["id"][:0], "neighbour_id": base["id"][:0], "distance": np.array([], float)})
        ids = own["id"].to_numpy()
        within = own["limit"].fillna(np.inf).to_numpy(dtype=float)
        r, n, d = nearest(stack(own["v"]), stack(base["v"]), base["id"].to_numpy(), k, ids if exclude_self else None, within)
        return pd.DataFrame({"query_id": ids[r], "neighbour_id": n, "distance": d})

    keys = ["cell", "block", "part"]
    return queries.groupBy(*keys).cogroup(bases.groupBy(*keys)).applyInPandas(search, schema)


def vote(
    neighbours: DataFrame, labels: DataFrame, n_classes: int, weights: str = "uniform"
) -> DataFrame:
    """(query_id, probability): share of the neighbours' (distance-weighted) votes per class.

    `labels` is (neighbour_id, label). Exact hits outvote everything under distance weights.
    """
    joined = neighbours.join(labels, "neighbour_id")
    if weights == "distance":
        hits = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
        joined = joined.withColumn(
            "_w",
            F.when(hits == 1, (F.col("distance") == 0).cast("double")).otherwise(
                1 / F.nullif(F.col("distance"), F.lit(0.0))
            ),
        )
    else:
        joined = joined.withColumn("_w", F.lit(1.0))
    shares = [
        F.sum(F.when(F.col("label") == float(c), F.col("_w")).otherwise(0.0)) / F.sum("_w")
        for c in range(n_classes)
    ]
    return joined.groupBy("query_id").agg(F.array(*shares).alias("probability"))
