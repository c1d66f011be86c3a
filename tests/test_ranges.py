"""Overlapping ranges by dyadic intervals against a plain search, and softmax sums by bands against a plain softmax."""

import math
import random

import pytest
from pyspark.sql import functions as F

from permaway.operators import graph, joins


@pytest.mark.parametrize("seed,n,upper", [(1, 1, 12), (2, 40, 12), (3, 300, 3)])
def test_first_range_that_holds_a_point(spark, monkeypatch, seed, n, upper):
    monkeypatch.setattr(joins, "UPPER_LEVELS", upper)
    pick = random.Random(seed)
    ranges = []
    for i in range(n):
        a = float(pick.randint(0, 60)) if pick.random() < 0.5 else pick.uniform(0, 60)
        ranges.append((pick.randint(-5, 5) * 1000 + i, a, a + pick.choice([0.0, 1.0, pick.uniform(0, 50), -3.0]), f"r{i}"))
    ranges += [(9_000_001, None, 50.0, "no start"), (9_000_002, 1.0, None, "no end")]
    points = [(i, float(pick.randint(-2, 62)) if i % 2 else pick.uniform(-2, 62)) for i in range(400)] + [(400, None)]
    got = joins.range_lookup(
        spark.createDataFrame(points, "id long, at double"), spark.createDataFrame(ranges, "o long, a double, b double, name string"),
        at="at", order="o", start="a", end="b", keep=["name"], point_id="id",
    ).collect()
    assert len(got) == len(points)
    whole = [r for r in ranges if r[1] is not None and r[2] is not None]
    for r in got:
        held = [x for x in whole if r["at"] is not None and x[1] <= r["at"] <= x[2]]
        assert r["name"] == (min(held)[3] if held else None)


def test_no_ranges(spark):
    got = joins.range_lookup(
        spark.createDataFrame([(1, 2.0)], "id long, at double"), spark.createDataFrame([], "o long, a double, b double, name string"),
        at="at", order="o", start="a", end="b", keep=["name"], point_id="id",
    ).collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, None)]


def test_no_python_for_ranges(spark):
    rows = spark.range(50).select("id", F.col("id").cast("double").alias("at"))
    plan = joins.range_lookup(rows, rows.select(F.col("id").alias("o"), "at", F.col("id").alias("name")), at="at", order="o", start="at", end="at", keep=["name"], point_id="id")
    assert "Python" not in plan._jdf.queryExecution().toString() and "MapInPandas" not in plan._jdf.queryExecution().toString()


def test_softmax_sums_of_a_hub(spark):
    pick = random.Random(4)
    rows = [("hub" if i % 3 else f"d{i % 7}", pick.choice(["a", "b", "c"]), pick.choice([pick.uniform(-2, 2), pick.uniform(-900, 900)]), pick.uniform(0, 2), [pick.gauss(0, 1), pick.gauss(0, 1)]) for i in range(600)]
    edges = spark.createDataFrame(rows, "dst string, type string, score double, weight double, x array<double>").repartition(7)
    sums = graph.attention_sums(edges, ["a", "b"], 2)
    assert "Join" not in sums._jdf.queryExecution().toString()
    got = {r.id: (r.m0, r.m1) for r in sums.collect()}
    for dst in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == dst]
        top = max(r[2] for r in own)
        e = [math.exp(r[2] - top) for r in own]
        for n, kind in enumerate("ab"):
            for i in range(2):
                want = sum(w * r[3] * r[4][i] for w, r in zip(e, own) if r[1] == kind) / (sum(e) + 1e-8)
                assert got[dst][n][i] == pytest.approx(want, rel=1e-9, abs=1e-12)
