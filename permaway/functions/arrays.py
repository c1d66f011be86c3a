"""Vector and map arithmetic on array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the first model outputs (fixed values).
OUTPUT_NAMES = ["defect_prob", "maintenance_urgency", "severity_score"]


def fit_length(values: Column, size: int) -> Column:
    """Cut or zero-pad an array to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), size)), 1, size)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_times_matrix(vector: Column, columns: list[list[float]]) -> Column:
    """``vector @ W`` with ``W`` given by its columns. A vector of another length, or with nulls, gives nulls.

    Whole Arrow batches are multiplied, entry after entry as ``dot`` adds them up.
    """
    weights = np.array(columns, dtype=float).T

    @F.arrow_udf("array<double>")
    def product(vectors: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(weights)), False)
        entries = vectors.filter(fits).flatten()
        given = entries.to_numpy(zero_copy_only=False).reshape(-1, len(weights))
        known = fits.to_numpy(zero_copy_only=False).copy()
        out = np.zeros((len(vectors), weights.shape[1]))
        sums = np.zeros((len(given), weights.shape[1]))
        with np.errstate(all="ignore"):
            for entry, row in zip(given.T, weights, strict=True):
                sums += entry[:, None] * row
        out[known] = sums
        known[known] = entries.is_valid().to_numpy(zero_copy_only=False).reshape(given.shape).all(1)
        ends = pa.array(np.arange(len(out) + 1) * weights.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel(), mask=np.repeat(~known, weights.shape[1])))

    return product(vector)


def l2_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))


def clip_to_norm(values: Column, max_norm: float = 1.0) -> Column:
    """Scale a vector down to ``max_norm`` when it is longer."""
    norm = l2_norm(values)
    factor = F.when(norm > max_norm, F.lit(max_norm) / norm).otherwise(F.lit(1.0))
    return F.transform(values, lambda x: x * factor)


def _moments(values: Column, finish) -> Column:
    """Count, mean and sum of squared deviations in one walk over the array."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n, mean = acc["n"] + 1.0, acc["mean"] + (x - acc["mean"]) / (acc["n"] + 1.0)
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(values, start, add, finish)


def mean_of(values: Column) -> Column:
    return _moments(values, lambda m: m["mean"])


def variance_of(values: Column) -> Column:
    return _moments(values, lambda m: m["m2"] / m["n"])


def gaussian_divergence(
    values: Column, global_mean: Column | float = 0.0, global_var: Column | float = 1.0, floor: float = 1e-8
) -> Column:
    """|KL| of a vector's fitted Gaussian against the global one; 0 for an empty vector."""
    mu = global_mean if isinstance(global_mean, Column) else F.lit(float(global_mean))
    var = F.greatest(global_var if isinstance(global_var, Column) else F.lit(float(global_var)), F.lit(floor))

    def divergence(m: Column) -> Column:
        own = F.greatest(m["m2"] / m["n"], F.lit(floor))
        return F.abs(F.log(F.sqrt(var) / F.sqrt(own)) + (own + F.pow(m["mean"] - mu, 2)) / (2 * var) - 0.5)

    return F.when(F.size(values) > 0, _moments(values, divergence)).otherwise(F.lit(0.0))


def haar_step(values: Column) -> Column:
    """One wavelet level: struct of ``approx`` and ``detail`` arrays of half the length."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(values) / 2).cast("int") - 1)
    root = F.lit(2.0 ** 0.5)
    approx = F.transform(pairs, lambda i: (F.get(values, 2 * i) + F.get(values, 2 * i + 1)) / root)
    detail = F.transform(pairs, lambda i: (F.get(values, 2 * i) - F.get(values, 2 * i + 1)) / root)
    enough = F.size(values) >= 2
    empty = F.array().cast("array<double>")
    return F.struct(
        F.when(enough, approx).otherwise(values).alias("approx"),
        F.when(enough, detail).otherwise(empty).alias("detail"),
    )


def sign_step(values: Column, gradient: Column, epsilon: float, low: Column, high: Column) -> Column:
    """``x + epsilon * sign(g)``, held inside the data range."""
    return F.zip_with(
        values, gradient, lambda x, g: F.least(F.greatest(x + F.lit(epsilon) * F.signum(g), low), high)
    )


def named_outputs(outputs: Column) -> Column:
    """First model outputs as a map, rounded to 4 places."""
    n = F.least(F.size(outputs), F.lit(len(OUTPUT_NAMES)))
    names = F.slice(F.array(*[F.lit(x) for x in OUTPUT_NAMES]), F.lit(1), n)
    return F.map_from_arrays(names, F.transform(F.slice(outputs, F.lit(1), n), lambda v: F.round(v, 4)))


def output_confidence(outputs: Column) -> Column:
    return F.coalesce(F.round(F.array_max(outputs), 4), F.lit(0.0))
