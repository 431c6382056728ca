"""Linear SVM with squared hinge loss by a trust-region Newton method.

Minimises w'w / 2 + C * sum of weight * max(0, 1 - y (w'x))^2, the constant being one more feature and
penalised like the others. Several problems (classes, and the training sides of folds) are solved together:
each gradient and each product of a Hessian with a vector is one aggregate over the rows for all
of them, and the driver holds a vector per problem.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import sized
from .histograms import TASK_ROWS, matrix

TOLERANCE = 1e-6
MAX_STEPS = 200


@dataclass(frozen=True)
class Problem:
    """Which label counts as +1, and the fold whose rows take no part (-1: none)."""

    positive: int
    without: int = -1


def _summed(rows: DataFrame, size: int, part) -> np.ndarray:
    """Sum of `part(x, label, fold, weight)`, a vector of `size` numbers, over all batches."""
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), len(batch.column("x")[0]))
                x = np.c_[x, np.ones(len(x))]
                total += part(x, *(batch.column(c).to_numpy() for c in ("label", "fold", "weight")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], schema=schema)

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row per number
        out[r["i"]] = r["v"]
    return out


def _signs(problems: list[Problem], label: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = np.where(label[:, None] == np.array([p.positive for p in problems]), 1.0, -1.0)
    return y, np.where(fold[:, None] == np.array([p.without for p in problems]), 0.0, weight[:, None])


def _values(rows: DataFrame, problems: list[Problem], w: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Objective and gradient of every problem at its column of `w`."""
    d, p = w.shape

    def part(x, label, fold, weight):
        y, share = _signs(problems, label, fold, weight)
        slack = np.maximum(0, 1 - y * (x @ w))
        return np.r_[(share * slack**2).sum(0), (x.T @ (share * y * slack)).ravel()]

    total = _summed(rows, p + d * p, part)
    return (w**2).sum(0) / 2 + c * total[:p], w - 2 * c * total[p:].reshape(d, p)


def _curved(rows: DataFrame, problems: list[Problem], w: np.ndarray, v: np.ndarray, c: float) -> np.ndarray:
    """The Hessian of every problem at `w` times its column of `v`."""
    d, p = w.shape

    def part(x, label, fold, weight):
        y, share = _signs(problems, label, fold, weight)
        held = share * (y * (x @ w) < 1)
        return (x.T @ (held * (x @ v))).ravel()

    return v + 2 * c * _summed(rows, d * p, part).reshape(d, p)


def _step(rows: DataFrame, problems: list[Problem], w: np.ndarray, g: np.ndarray, radius: np.ndarray, busy: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Conjugate gradients inside the trust region, for all busy problems; the step and what is left of the gradient."""
    s, r = np.zeros_like(w), -g
    v = r.copy()
    enough = 0.1 * np.linalg.norm(g, axis=0)
    going = busy.copy()
    for _ in range(len(w) + 5):
        going &= np.linalg.norm(r, axis=0) > enough
        if not going.any():
            break
        hv = _curved(rows, problems, w, np.where(going, v, 0.0), c)
        rr = (r**2).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(going, rr / (v * hv).sum(0), 0.0)
        out = going & (np.linalg.norm(s + alpha * v, axis=0) > radius)
        if out.any():  # stop at the border
            sv, vv, ss = (s * v).sum(0), (v**2).sum(0), (s**2).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                edge = (-sv + np.sqrt(np.maximum(sv**2 + vv * (radius**2 - ss), 0))) / vv
            alpha = np.where(out, edge, alpha)
        s, r = s + np.where(going, alpha * v, 0.0), r - np.where(going, alpha * hv, 0.0)
        going &= ~out
        with np.errstate(divide="ignore", invalid="ignore"):
            beta = np.where(going, (r**2).sum(0) / rr, 0.0)
        v = np.where(going, r + beta * v, v)
    return s, r


def solve(train: DataFrame, problems: list[Problem], c: float, fold: Column | None = None, tolerance: float = TOLERANCE) -> np.ndarray:
    """One column of coefficients per problem, the constant last, with a gradient of at most `tolerance` times the first one.

    `train` holds `features`, `_label` and perhaps `_weight`; `fold` numbers the rows' folds.
    """
    weight = F.col("_weight") if "_weight" in train.columns else F.lit(1.0)
    fold = F.lit(-2) if fold is None else fold
    rows = train.select(
        vector_to_array("features").alias("x"), F.col("_label").cast("double").alias("label"), fold.cast("int").alias("fold"), weight.cast("double").alias("weight")
    )
    rows = sized(rows, train.count(), TASK_ROWS).persist()
    try:
        first = rows.first()
        if first is None:
            raise ValueError("no rows to train on")
        w = np.zeros((len(first["x"]) + 1, len(problems)))
        f, g = _values(rows, problems, w, c)
        norm = np.linalg.norm(g, axis=0)
        limit, radius = tolerance * norm, norm.copy()
        for _ in range(MAX_STEPS):
            busy = np.linalg.norm(g, axis=0) > limit
            if not busy.any():
                break
            s, r = _step(rows, problems, w, g, radius, busy, c)
            f_new, g_new = _values(rows, problems, w + s, c)
            gs = (g * s).sum(0)
            promised = -0.5 * (gs - (s * r).sum(0))
            gained, size = f - f_new, np.linalg.norm(s, axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = np.where(promised > 0, gained / promised, 0.0)
            flat = busy & (np.abs(gained) <= 1e-14 * np.abs(f)) & (promised <= 1e-14 * np.abs(f))  # as near as doubles get
            good = busy & ((fit > 1e-4) | flat)
            radius = np.where(busy & (fit < 0.25), np.minimum(radius, size) * 0.25, np.where(busy & (fit > 0.75), np.maximum(radius, 2 * size), radius))
            w, f, g = np.where(good, w + s, w), np.where(good, f_new, f), np.where(good, g_new, g)
            limit = np.where(flat, np.inf, limit)
        return w
    finally:
        rows.unpersist()


def decision(features: Column, w: list[list[float]]) -> list[Column]:
    """w'x plus the constant per column of coefficients."""
    x = vector_to_array(features)
    out = []
    for each in w:
        terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in each[:-1]]), lambda a, b: a * b)
        out.append(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + float(each[-1]))
    return out
