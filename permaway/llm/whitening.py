"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows A (one for each distinct vector, over the root of their number) stay in a table; the driver holds vectors as
long as an embedding. A left vector u is never stored: it is A w for some w of that length. One pass over the table gives
A v for the next right vector v, its products with all earlier u (for reorthogonalisation) and A'u at once. With
A V = U B, the singular values of the small B are the deviations, and V times its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.store import Scratch

#: Entries become whole numbers: SCALE times the entry, rounded down, plus SHIFT. Larger ones than LIMIT count as LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
#: Singular values below this part of the largest are those of directions without any deviation.
NO_DEVIATION = 1e-11
#: A new direction shorter than this part of the largest singular value is rounding.
ROUNDING = 1e-13


@dataclass
class Whitening:
    """sums / n is the mean of the fitted vectors; a column of `components` for each of the `deviations`, falling."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; whole numbers are subtracted first, so no digits are lost to the shift."""
        return _centred(x, self.sums, self.n)


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    return (x - sums // n).astype(np.float64) - (sums % n) / n


def usable(vector: str) -> Column:
    """Vectors with entries that are all there and finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def whole_numbers(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and x (array of long) of the usable vectors of the most common length, the longest of several."""
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = own.where(F.coalesce(usable("v"), F.lit(False)))
    lengths = own.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    size = lengths[0]["length"] if lengths else 0
    bounded = lambda c: F.least(F.greatest(c, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    x = F.transform("v", lambda c: F.floor(bounded(SCALE * c)).cast("long") + SHIFT)
    return own.where(F.size("v") == size).select("id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each list of a column whose lists have one length."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def column_sums(table: DataFrame, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of `work` (a vector) over the batches of column x. Tasks add up their batches, Spark adds up the tasks' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "part"])

    rows = table.select("x").mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("part")).collect()
    return np.array([r["part"] for r in sorted(rows, key=lambda r: r["place"])])


class Bidiagonalisation:
    """Right vectors, the w of left vectors, and B, a step at a time."""

    def __init__(self, product: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, seed: int = 1) -> None:
        """product: for weights M (size x k), the products of A M with its first column, and A' times that column."""
        self.product, self.size, self.random = product, size, np.random.default_rng(seed)
        self.right, self.left, self.back = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros((size, 0))
        self.entries: dict[tuple[int, int], float] = {}  # of B, by left and right vector
        self.scale = 0.0
        self.next, self.beta = self._orthogonal(self.random.standard_normal(size))[0], 0.0

    def _orthogonal(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        """What of v is orthogonal to the right vectors, as a unit vector, and its length."""
        for _ in range(2):
            v = v - self.right @ (self.right.T @ v)
        length = float(np.linalg.norm(v))
        return v / length if length else v, length

    def matrix(self) -> np.ndarray:
        b = np.zeros((self.left.shape[1], self.right.shape[1]))
        for place, value in self.entries.items():
            b[place] = value
        return b

    def step(self) -> None:
        """One pass over the rows: a new right vector, and the left vector that it leads to."""
        v, j, k = self.next, self.right.shape[1], self.left.shape[1]
        self.right = np.column_stack([self.right, v])
        w = v
        if self.beta:
            self.entries[k - 1, j] = self.beta
            w = v - self.beta * self.left[:, -1]
        dots, back = self.product(np.column_stack([w, self.left]))
        # What is left of earlier left vectors by rounding is taken out of the new one, of its length and of its product.
        w, back, square = w - self.left @ dots[1:], back - self.back @ dots[1:], dots[0] - float(dots[1:] @ dots[1:])
        if self.beta:
            self.entries[k - 1, j] += float(dots[-1])
        for i, dot in enumerate(dots[1:-1] if self.beta else dots[1:]):
            if abs(dot) > ROUNDING * self.scale:
                self.entries[i, j] = float(dot)
        alpha = float(np.sqrt(max(square, 0.0)))
        self.scale = max(self.scale, alpha, self.beta)
        self.beta = 0.0
        if alpha > ROUNDING * self.scale:
            self.entries[k, j] = alpha
            self.left, self.back = np.column_stack([self.left, w / alpha]), np.column_stack([self.back, back / alpha])
            self.next, self.beta = self._orthogonal(back / alpha - alpha * v)
        if self.beta <= ROUNDING * self.scale and j + 1 < self.size:
            # The rows lead to no new direction: start again with any other one.
            self.next, self.beta = self._orthogonal(self.random.standard_normal(self.size))[0], 0.0

    def settled(self, most: int, trace: float) -> bool:
        """Whether the first `most` components are final: all directions are there; or their residuals are rounding and what
        the other directions can hold of the trace is less than the least of them."""
        if self.right.shape[1] == self.size:
            return True
        if self.right.shape[1] <= most or not trace:
            return not trace
        b = self.matrix()
        u, s, _ = np.linalg.svd(b)
        rest = trace - float((b**2).sum())
        residual = self.beta * np.abs(u[-1, :most]) if self.beta else np.zeros(1)
        return bool(max(rest, 0.0) < 0.5 * s[most - 1] ** 2 and residual.max() <= 1e-15 * s[0])


def fit(vectors: DataFrame, most: int = 16) -> Whitening:
    """Components of the distinct vectors x of `vectors`, up to `most`. Passes over the table: at most the length of a vector, and three.

    No vectors, or only one, have no components. Directions without deviation are no components.
    """
    scratch = Scratch(vectors.sparkSession)
    table = scratch.table(vectors.select("x").distinct(), "whitening")
    counted = column_sums(table, lambda x: np.append(x.sum(0), len(x)), "long")
    if not len(counted):
        scratch.drop()
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    sums, n = counted[:-1], int(counted[-1])
    trace = float(column_sums(table, lambda x: np.array([(_centred(x, sums, n) ** 2).sum()]), "double")[0]) / n

    def product(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(x: np.ndarray) -> np.ndarray:
            rows = _centred(x, sums, n)
            y = rows @ m
            return np.concatenate([y.T @ y[:, 0], rows.T @ y[:, 0]])

        found = column_sums(table, work, "double") / n
        return found[: m.shape[1]], found[m.shape[1] :]

    steps = Bidiagonalisation(product, len(sums))
    while not steps.settled(most, trace):
        steps.step()
    _, s, vt = np.linalg.svd(steps.matrix(), full_matrices=False) if steps.left.shape[1] else (None, np.zeros(0), np.zeros((0, len(sums))))
    there = np.flatnonzero(s > NO_DEVIATION * s[0])[:most] if len(s) else np.zeros(0, int)
    components, deviations = (steps.right @ vt.T)[:, there] if len(there) else np.zeros((len(sums), 0)), s[there]

    def spread(x: np.ndarray) -> np.ndarray:
        z = _centred(x, sums, n) @ (components / deviations)
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    error = 0.0
    if len(there):
        k = len(there)
        found = column_sums(table, spread, "double") / n
        error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :]) - np.eye(k)).max())
    scratch.drop()
    return Whitening(n, sums, components, deviations, deviations**2 / trace if len(there) else np.zeros(0), error)


def distance_from_mean(x: np.ndarray, sums: np.ndarray, n: int) -> pa.Array:
    """The exact sum of (n x - sums)^2; null where 64 bits do not hold it."""
    far = n * x - sums
    if not far.size or float(np.abs(far).max()) ** 2 * far.shape[1] < 9e18:
        return pa.array((far * far).sum(1) if far.size else np.zeros(len(x), np.int64), pa.int64())
    exact = [sum(int(c) ** 2 for c in row) for row in far]
    return pa.array([c if c < 1 << 63 else None for c in exact], pa.int64())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation and `whitened`, an array with a number for each component, for each row of `vectors`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.components / model.deviations
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                z = model.centred(x) @ weights
                offsets = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
                white = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), distance_from_mean(x, model.sums, model.n), white], ["id", "deviation", "whitened"])

    return vectors.select("id", "x").mapInArrow(run, "id long, deviation long, whitened array<double>")


def whitened_rows(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """One row for each usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Null vectors, empty ones, ones with null or non-finite entries, and ones of another length than most are left out.
    Repeated rows, ids and null ids are rows like any other, but equal vectors count once in the fit. Without two different vectors
    there is no component and so no row; there are fewer than `most` where the vectors vary in fewer directions. Other columns are not looked at.
    """
    vectors = whole_numbers(rows, id_column, vector)
    model = fit(vectors, most)
    explained = F.array(*(F.lit(float(x)) for x in model.explained)).cast("array<double>")
    found = whiten(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return found.select(
        "id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
