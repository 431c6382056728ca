"""Exact interpolated quantiles of many columns without holding a column in one task.

The built-in exact percentile keeps every distinct value in one aggregation buffer, which is fine
for small tables only. On large ones each wanted order statistic is bracketed with the mergeable
quantile sketch and the bracket is narrowed pass by pass (all columns and probabilities share a
pass) until the few values left inside are fetched exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import dropped, staged
from .columns import q

SKETCH_ACCURACY = 10_000
GRID_STEPS = 256
# every pass keeps at most a few of the 256 grid steps, so 2^63 rows need under ten
MAX_PASSES = 30


@dataclass
class _Search:
    """One order statistic: the value of 0-based rank `rank` of `column` (nulls left out)."""

    column: str
    rank: int
    low: float  # the answer lies in [low, high]
    high: float
    answer: float | None = None


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    approx: bool = False,
    exact_rows: int = 200_000,
    rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; `approx=True` takes the sketch's answer."""
    if not columns:
        return {}
    if approx:
        row = df.agg(
            *[F.percentile_approx(q(c), probabilities, 10_000).alias(f"p_{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: list(row[i] or [None] * len(probabilities)) for i, c in enumerate(columns)}
    rows = df.count() if rows is None else rows
    if rows <= exact_rows:
        row = df.agg(
            *[F.percentile(q(c), F.array(*[F.lit(p) for p in probabilities])).alias(f"p_{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: list(row[i] or [None] * len(probabilities)) for i, c in enumerate(columns)}
    return _refined(df, columns, probabilities)


def _refined(
    df: DataFrame, columns: list[str], probabilities: list[float], fetch: int = 10_000
) -> dict[str, list[float | None]]:
    values = df.select(*[q(c).cast("double").alias(f"v_{i}") for i, c in enumerate(columns)])
    name = {c: f"v_{i}" for i, c in enumerate(columns)}
    first = values.agg(
        *[e for v in name.values() for e in (F.count(v).alias(f"n_{v}"), F.min(v).alias(f"lo_{v}"), F.max(v).alias(f"hi_{v}"))]
    ).first()
    searches: dict[tuple[str, int], _Search] = {}
    plan: dict[tuple[str, float], tuple[int, int, float]] = {}
    for c, v in name.items():
        n = first[f"n_{v}"]
        if not n:
            continue
        for p in probabilities:
            position = p * (n - 1)
            below = math.floor(position)
            above = min(below + 1, n - 1)
            plan[c, p] = (below, above, position - below)
            for rank in (below, above):
                # open bracket (low, high): start just outside the observed range
                searches.setdefault(
                    (c, rank),
                    _Search(c, rank, math.nextafter(first[f"lo_{v}"], -math.inf), math.nextafter(first[f"hi_{v}"], math.inf)),
                )
    for _ in range(MAX_PASSES):
        open_searches = [s for s in searches.values() if s.answer is None]
        if not open_searches:
            break
        _narrow(values, name, open_searches, fetch)
    else:
        raise RuntimeError("quantile search did not converge")
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            if (c, p) not in plan:
                out[c].append(None)
                continue
            below, above, weight = plan[c, p]
            low, high = searches[c, below].answer, searches[c, above].answer
            out[c].append(low + (high - low) * weight)
    return out


def _narrow(values: DataFrame, name: dict[str, str], searches: list[_Search], fetch: int) -> None:
    """One pass: count around every bracket and sketch what lies inside it."""
    brackets = sorted({(s.column, s.low, s.high) for s in searches})
    at_bracket = {b: i for i, b in enumerate(brackets)}
    cells = []
    for i, (column, low, high) in enumerate(brackets):
        v = F.col(name[column])
        inside = (v > low) & (v < high)
        cells += [
            F.count_if(v <= low).alias(f"upto_{i}"),
            F.count_if(inside).alias(f"in_{i}"),
            F.percentile_approx(
                F.when(inside, v), [k / GRID_STEPS for k in range(GRID_STEPS + 1)], SKETCH_ACCURACY
            ).alias(f"grid_{i}"),
        ]
    row = values.agg(*cells).first()
    fetches: dict[int, list[tuple[_Search, int]]] = {}
    for s in searches:
        i = at_bracket[s.column, s.low, s.high]
        offset, size = s.rank - row[f"upto_{i}"], row[f"in_{i}"]
        if offset < 0:
            s.answer = s.low
        elif offset >= size:
            s.answer = s.high
        elif size <= fetch:
            fetches.setdefault(i, []).append((s, offset))
        elif row[f"grid_{i}"][0] == row[f"grid_{i}"][-1]:
            s.answer = row[f"grid_{i}"][0]  # the ends of the grid are the extremes: all values equal
        else:
            # The sketch is off by at most size/accuracy ranks; one grid step is far wider.
            # Grid points are values of the column, so an edge can itself be the answer; only
            # at the two ends is the edge opened so that the extreme value stays inside.
            grid, at = row[f"grid_{i}"], offset / size * GRID_STEPS
            left, right = max(math.floor(at) - 1, 0), min(math.ceil(at) + 1, GRID_STEPS)
            low, high = grid[left], grid[right]
            if left == 0 or low == high:
                low = math.nextafter(low, -math.inf)
            if right == GRID_STEPS:
                high = math.nextafter(high, math.inf)
            s.low, s.high = max(s.low, low), min(s.high, high)
    if fetches:
        cells = []
        for i in fetches:
            column, low, high = brackets[i]
            v = F.col(name[column])
            cells.append(
                F.array_sort(F.collect_list(F.when((v > low) & (v < high), v))).alias(f"f_{i}")
            )
        got = values.agg(*cells).first()
        for i, wanted in fetches.items():
            for s, offset in wanted:
                s.answer = got[f"f_{i}"][offset]


def many_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], tasks: int) -> dict[str, list[float]]:
    """Exact interpolated quantiles for hundreds of probabilities: the same numbers as the built-in percentile gives.

    Distinct values are counted and written in order, `tasks` ranges of (column, value); the driver learns how many values
    each range holds and then only the wanted ones. NaN and null do not count.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), (q(c).cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)])
    found = df.select(F.inline(cells)).where("v IS NOT NULL AND NOT isnan(v)").groupBy("c", "v").agg(F.count("*").alias("n"))

    def packed(batches):
        from pyspark import TaskContext

        parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in ("c", "v", "n")] for b in batches if b.num_rows]
        if parts:
            c, v, n = (np.concatenate(p) for p in zip(*parts))
            for i in np.unique(c).tolist():
                own = c == i
                row = [TaskContext.get().partitionId(), i, int(n[own].sum()), v[own].tobytes(), n[own].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "c", "total", "v", "n"])

    ordered = found.repartitionByRange(tasks, "c", "v").sortWithinPartitions("c", "v")
    table = staged(ordered.mapInArrow(packed, "part long, c long, total long, v binary, n binary"), "quantiles")
    try:
        before: dict[tuple[int, int], int] = {}
        counts = [0] * len(columns)
        for r in table.select("part", "c", "total").orderBy("c", "part").collect():  # a row per column and range
            before[r["part"], r["c"]] = counts[r["c"]]
            counts[r["c"]] += r["total"]
        places = [[p * (n - 1) for p in probabilities] if n else [] for n in counts]
        wanted = [np.unique([r for x in own for r in (math.floor(x), math.ceil(x))]).astype(np.int64) for own in places]

        def picked(batches):
            for batch in batches:
                for part, c, v, n in zip(*(batch.column(k).to_pylist() for k in ("part", "c", "v", "n"))):
                    upto = before[part, c] + np.cumsum(np.frombuffer(n, np.int64))
                    ranks = wanted[c][(wanted[c] >= before[part, c]) & (wanted[c] < upto[-1])]
                    values = np.frombuffer(v)[np.searchsorted(upto, ranks, side="right")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), c)), pa.array(ranks), pa.array(values)], names=["c", "r", "v"])

        at = {(r["c"], r["r"]): r["v"] for r in table.mapInArrow(picked, "c long, r long, v double").collect()}
    finally:
        dropped(table)

    def between(c: int, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        a, b = at[c, low], at[c, high]
        return a if low == high or a == b else (high - x) * a + (x - low) * b

    return {name: [between(i, x) for x in places[i]] or [None] * len(probabilities) for i, name in enumerate(columns)}
