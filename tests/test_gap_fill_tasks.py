"""Filled rows are made in many tasks, and those added up where they are made are those that come out one by one."""

import math

import pytest
from pyspark.sql import functions as F

from permaway.operators import ordered
from permaway.plans import QUERIES
from tests.conftest import DATA

ROWS = "asset string, t double, a double, b double, tie bigint"
READINGS = [
    ("x", 10.0, 1.0, None, 1), ("x", 400.0, 2.0, 5.0, 2), ("x", 400.0, 9.0, 9.0, 3), ("x", 9000.25, None, 6.0, 4), ("x", 9100.0, 4.0, 7.0, 5),
    ("x", 99000.0, -3.0, 8.0, 6), ("y", 3600.0, 1.0, None, 7), ("y", 7200.0, 2.0, None, 8), (None, 5.0, 1.0, 1.0, 9), (None, 4000.0, 2.0, 2.0, 10),
    ("z", -5000.0, 1.0, 1.0, 11), ("z", 20.5, 3.0, 2.0, 12), ("v", 1.0, None, 1.0, 13), ("w", None, 2.0, 1.0, 14),
]


@pytest.mark.parametrize("at_once", [1, 1000, 1 << 15])
def test_added_up_rows_are_the_filled_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(ordered, "FILL_ROWS", at_once)
    df = spark.createDataFrame(READINGS, ROWS)
    rows = ordered.gap_fill(df, "asset", "t", ["a", "b"], "tie").withColumn("window", F.floor(F.col("t") / 3600))
    expected = rows.groupBy("asset", "window").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_interpolated").alias("interpolated"),
        F.sum(F.col("t") - F.col("window") * 3600).alias("offset_s"), F.sum("a").alias("a"), F.sum("b").alias("b"),
    )
    summed = ordered.gap_fill(df, "asset", "t", ["a", "b"], "tie", window_s=3600)
    got = summed.groupBy("asset", "window").agg(*[F.sum(c).alias(c) for c in ("rows", "interpolated", "offset_s", "a", "b")])
    assert got.dtypes == expected.dtypes
    assert summed.count() < rows.count() / 10
    held = {tuple(r[:2]): tuple(r[2:]) for r in got.collect()}
    wanted = {tuple(r[:2]): tuple(r[2:]) for r in expected.collect()}
    assert held.keys() == wanted.keys() and len(wanted) > 20
    for key, row in wanted.items():
        assert held[key][:2] == row[:2]
        for mine, theirs in zip(held[key][2:], row[2:], strict=True):
            assert mine is theirs is None or math.isclose(mine, theirs, rel_tol=1e-12, abs_tol=1e-9)


def test_gaps_are_filled_in_as_many_tasks_as_partitions(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame([(f"k{i % 40}", float(1000 * i), 1.0, 1.0, i) for i in range(400)], ROWS)
    made = ordered.gap_fill(df, "asset", "t", ["a"], "tie").withColumn("task", F.spark_partition_id())
    assert len({r["task"] for r in made.select("task").distinct().collect()}) == parts
    hours = QUERIES["gap_fill_hours"](spark, DATA)
    assert "MapInArrow" in hours._jdf.queryExecution().executedPlan().toString()
