"""Vectors times a fixed matrix."""

import math

import numpy as np
from pyspark.sql import functions as F

from permaway.functions.arrays import vector_times_matrix


def test_many_vectors_meet_a_matrix_in_arrow(spark):
    draw = np.random.default_rng(3)
    weights = draw.normal(size=(4, 3))
    vectors = [*draw.normal(size=(50, 4)).tolist(), None, [1.0, None, 2.0, 3.0], [1.0, 2.0], [], [float("nan"), 1.0, 1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>").repartition(3)
    out = df.select("id", vector_times_matrix(F.col("v"), weights.T.tolist()).alias("p"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["p"] for r in out.collect()}
    for i, v in enumerate(vectors[:50]):
        expected = [0.0, 0.0, 0.0]
        for x, row in zip(v, weights, strict=True):
            expected = [e + x * w for e, w in zip(expected, row, strict=True)]
        assert got[i] == expected
    assert [got[i] for i in range(50, 54)] == [[None] * 3] * 4
    assert all(math.isnan(x) for x in got[54])
