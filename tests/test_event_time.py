"""Machines in event time: rows in any order give the batch rows, late ones come out by themselves, and state goes."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from permaway.operators import stateful
from permaway.plans.registry import events
from permaway.streaming import stateful as streams
from tests.conftest import DATA
from tests.test_streaming import MACHINES, collect, same_rows

ROWS = "user_id bigint, row_id bigint, t double, ts timestamp, value double, event_type string, k bigint, lat double, lon double"
END = 4_000_000_000.0


def written(spark, path, parts):
    """Each part as one file, read one file per micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events dealt to four files without regard to time; a fifth file lets the watermark pass them all."""
    e = events(spark, DATA).select(
        "user_id", F.col("event_id").alias("row_id"), (F.col("us") / 1e6).alias("t"), "ts", "value", "event_type", "k",
        (28.6 + (F.col("user_id") % 12) * 0.0003).alias("lat"), (77.2 + (F.col("k") % 5) * 0.0002).alias("lon"),
    )
    batch = spark.createDataFrame(e.toPandas(), e.schema)
    last = spark.createDataFrame([(-1, -1, END, pd.Timestamp(END, unit="s").to_pydatetime(), 0.0, "end", 0, 0.0, 0.0)], ROWS).select(*batch.columns)
    parts = [batch.filter(F.abs(F.xxhash64("row_id")) % 4 == i) for i in range(4)] + [last]
    return batch, written(spark, str(tmp_path_factory.mktemp("shuffled")), parts)


CASES = {**MACHINES, "level": (lambda: stateful.kalman_level("user_id", "bigint"), {}), "motion": (lambda: stateful.kalman_motion("user_id", "bigint"), {})}


@pytest.mark.parametrize("name", list(CASES))
def test_any_order_gives_the_batch_rows(spark, shuffled, name):
    build, columns = CASES[name]
    batch, stream = (df.withColumns({k: F.expr(v) for k, v in columns.items()}) if columns else df for df in shuffled)
    machine = build()
    found = collect(spark, streams.event_time_machine(stream, ["user_id"], machine, "ts", delay="3650 days"), f"e_{name}")
    assert found.filter("late IS NOT NULL").count() == 0
    same_rows(stateful.run(batch, ["user_id"], machine), found.filter("user_id >= 0").drop("late"))


def test_suppression_in_any_order(spark, shuffled):
    machine = stateful.suppression("event_type", "string")
    batch, stream = shuffled
    found = collect(spark, streams.event_time_machine(stream, ["event_type"], machine, "ts", delay="3650 days"), "e_supp")
    same_rows(stateful.run(batch, ["event_type"], machine), found.filter("event_type <> 'end'").drop("late"))


def readings(spark, rows):
    data = [(k, i, t, pd.Timestamp(t, unit="s").to_pydatetime(), failed) for k, i, t, failed in rows]
    return spark.createDataFrame(data, "user_id bigint, row_id bigint, t double, ts timestamp, failed boolean")


def test_late_rows_and_forgotten_keys(spark, tmp_path):
    """The third failure of key 1 is late, so it does not count; key 2 is forgotten between its second and third."""
    parts = [
        readings(spark, [(1, 1, 100.0, True), (1, 3, 104.5, True), (2, 4, 100.0, True), (2, 5, 101.0, True)]),
        readings(spark, [(9, 6, 200.0, False)]),
        readings(spark, [(1, 2, 102.0, True), (1, 7, 199.0, True)]),
        readings(spark, [(9, 8, 5000.0, False)]),
        readings(spark, [(2, 9, 5001.0, True), (1, 10, 5001.0, True), (1, 11, 5001.5, True), (1, 12, 5001.25, True)]),
        readings(spark, [(9, 13, 9000.0, False)]),
        readings(spark, [(9, 14, 9001.0, False)]),
    ]
    stream = written(spark, str(tmp_path / "in"), parts)
    df = streams.event_time_machine(stream, ["user_id"], stateful.failure_counter("user_id", "bigint"), "ts", delay="5 seconds", idle_s=1000.0)
    query = df.writeStream.format("memory").queryName("e_late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    found = spark.table("e_late").collect()
    assert [(r.user_id, json.loads(r.late)["row_id"]) for r in found if r.late] == [(1, 2)]
    # Key 1: rows 1, 3 and 7 are three in a row; then it is forgotten, and 10, 12 and 11 are three in a row again.
    assert sorted((r.user_id, r.row_id) for r in found if not r.late) == [(1, 7), (1, 11)]
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "machine").load()
    assert not state.collect()  # the watermark is more than the time-out past what was stepped
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load()
    assert [r.key.user_id for r in waiting.collect()] == [9, 9]  # the last two rows, which it has not passed
