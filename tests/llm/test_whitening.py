import math

import numpy as np
import pytest

from permaway.llm import whitening
from permaway.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """The contract by NumPy's eigenvectors: rows are (id, vector)."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fitted = sorted({tuple(v) for v in x.values()})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    a = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fitted])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        far = [n * c - s for c, s in zip(v, sums)]
        out[i] = (n, sum(c * c for c in far), (np.array(far) / n) @ vectors / np.sqrt(np.maximum(values, 1e-30)), values / values.sum())
    return out


def check(got, want, most):
    assert len(got) == most * len(want) and len({(r[0], r.component) for r in got}) == len(got)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r[0]]
        k = r.component - 1
        sign = signs.setdefault(k, np.sign(r.whitened * white[k]) if abs(white[k]) > 1e-3 else 0)
        if not sign:
            signs.pop(k)
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened - (sign or np.sign(r.whitened * white[k])) * white[k]) < 1e-8
        assert r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-10


def test_query_against_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(QUERIES["op13_lanczos_whitening"](spark, FOLDER).collect(), plain(rows), 16)


def test_odd_rows_and_few_directions(spark):
    pick = np.random.default_rng(5)
    low = (pick.integers(-8, 9, (60, 3)) @ np.array([[8, 1, 0, 0, 2, 0], [0, 2, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0]])).astype(float)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(low)] + [(100, [float(c) for c in low[0]])] * 20
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whitened_rows(frame).collect()
    want = plain(rows)
    once = {(r.id, r.component): r for r in got}
    assert len(got) == 3 * len(rows)
    check(list(once.values()), want, 3)


def test_equal_deviations(spark):
    """Vectors along the axes: all eigenvalues are equal, and one start leads to one of their directions only."""
    rows = [(2 * i + s, [(1.0 - 2 * s) * (i == k) for k in range(8)]) for i in range(8) for s in range(2)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=5).collect()
    assert len(got) == 5 * 16
    assert all(r.explained == pytest.approx(1 / 8) and r.identity_error < 1e-10 for r in got)


def test_large_numbers(spark):
    rows = [(i, [1e300 if i == 0 else 2.0**30 * i, float(i % 3)]) for i in range(40)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and all(math.isfinite(r.whitened) for r in got)
    assert any(r.deviation is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_direction(spark, rows):
    assert whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_stops_early():
    """A table of few strong directions needs few passes."""
    pick = np.random.default_rng(2)
    a = pick.standard_normal((500, 4)) @ np.diag([100, 50, 20, 10]) @ pick.standard_normal((4, 40)) + 1e-9 * pick.standard_normal((500, 40))
    passes = 0

    def product(m):
        nonlocal passes
        passes += 1
        y = a @ m
        return y.T @ y[:, 0], a.T @ y[:, 0]

    steps = whitening.Bidiagonalisation(product, 40)
    while not steps.settled(4, float((a**2).sum())):
        steps.step()
    assert passes < 20
    assert np.linalg.svd(steps.matrix())[1][:4] == pytest.approx(np.linalg.svd(a)[1][:4], rel=1e-12)
