"""Multinomial logistic regressions of several penalties, fitted together: one pass over the data a step, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps that the descent remembers.
MEMORY = 10


@dataclass
class Descent:
    """L-BFGS with halved steps for one model, driven from outside: ``trial`` is the point to look at, ``see`` takes what was found there."""

    x: np.ndarray
    f: float = np.inf
    g: np.ndarray | None = None
    step: float = 1.0
    ahead: np.ndarray | None = None
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    @property
    def trial(self) -> np.ndarray:
        return self.x if self.ahead is None else self.x + self.step * self.ahead

    def see(self, f: float, g: np.ndarray, tolerance: float) -> None:
        if self.ahead is not None and f > self.f + 1e-4 * self.step * float(self.g @ self.ahead):
            self.step /= 2
            self.done = self.step < 1e-10
            return
        if self.ahead is not None:
            moved, turned = self.step * self.ahead, g - self.g
            if float(moved @ turned) > 1e-12:
                self.past = [*self.past, (moved, turned)][-MEMORY:]
            self.x = self.x + moved
        self.f, self.g = f, g
        self.done = float(np.abs(g).max()) < tolerance
        self.ahead = -self._scaled(g)
        self.step = 1.0 if self.past else min(1.0, 1.0 / max(float(np.linalg.norm(g)), 1e-12))

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y in reversed(self.past):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            used.append(a)
        if self.past:
            s, y = self.past[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.past, reversed(used), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        return q


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(rows, models, classes) by weights (models, classes, dimensions + 1), the intercept last."""
    z = np.einsum("nd,mkd->nmk", x, w[:, :, :-1], optimize=True) + w[None, :, :, -1]
    z -= z.max(axis=2, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=2, keepdims=True)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)


def _losses(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient) sums of all models over all rows (vector, y). A task hands on one vector."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(w.shape[0] + w.size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            p = _probabilities(x, w)
            at = np.arange(len(y))
            total[: w.shape[0]] -= np.log(np.maximum(p[at, :, y], 1e-300)).sum(axis=0)
            p[at, :, y] -= 1.0
            with_one = np.hstack([x, np.ones((len(x), 1))])
            total[w.shape[0] :] += np.einsum("nmk,nd->mkd", p, with_one, optimize=True).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    sums = rows.mapInArrow(part, "v array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first().v
    if sums is None:
        raise ValueError("there are no rows to fit")
    return np.array(sums[: w.shape[0]]), np.array(sums[w.shape[0] :]).reshape(w.shape)


def fit_penalties(
    data: DataFrame, grid: list[float], classes: int = 3, features: str = "vector", label: str = "label_id", max_passes: int = 200, tolerance: float = 1e-6,
) -> np.ndarray:
    """Weights (C, classes, dimensions + 1; the intercept last) of a model for each C of ``grid``: mean log loss with an L2 penalty of 1 / (C n) on
    all but the intercepts, the same objective as ``tiers.train_classifier``.

    Gradients of all models are summed in the same pass; the driver holds the weights and a few steps' differences of them, nothing of the data,
    which is read once a pass: hand over a cached or written table. Rows whose vector or label is null take no part.
    """
    rows = data.select(F.col(features).cast("array<double>").alias("vector"), F.col(label).cast("int").alias("y")).where("vector IS NOT NULL AND y IS NOT NULL")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"), F.min(F.size("vector")).alias("least")).first()
    if not seen.n or seen.d != seen.least:
        raise ValueError("vectors must have one length, and some must be there")
    shape = (classes, seen.d + 1)
    penalty = np.array([1.0 / (c * seen.n) for c in grid])
    models = [Descent(np.zeros(shape[0] * shape[1])) for _ in grid]
    for _ in range(max_passes):
        w = np.stack([m.trial.reshape(shape) for m in models])
        loss, slope = _losses(rows, w)
        free = w.copy()
        free[:, :, -1] = 0.0
        f = loss / seen.n + 0.5 * penalty * (free**2).sum(axis=(1, 2))
        g = slope / seen.n + penalty[:, None, None] * free
        for k, m in enumerate(models):
            if not m.done:
                m.see(float(f[k]), g[k].ravel(), tolerance)
        if all(m.done for m in models):
            break
    return np.stack([m.x.reshape(shape) for m in models])


def predictions(weights: np.ndarray) -> Callable[[Column], Column]:
    """Vectors to the class (array<int>, one a model) of greatest probability, the first of equal ones."""
    def classes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            best = _probabilities(_matrix(vectors), weights).argmax(axis=2) if len(vectors) else np.zeros((0, len(weights)), dtype=int)
            yield pa.array(best.tolist(), pa.list_(pa.int32()))

    return F.arrow_udf(classes, "array<int>")
