"""Streaming forms give the rows of the batch forms when the input is replayed in order."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from permaway.operators import ordered, stateful, validate
from permaway.plans.registry import events
from permaway.sources import feeds
from permaway.streaming import stateful as streams
from tests.conftest import DATA


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Events as time-ordered files, read one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("replay"))
    e = events(spark, DATA).select("user_id", F.col("event_id").alias("row_id"), (F.col("us") / 1e6).alias("t"), "value", "event_type", "k", "ts")
    batch = spark.createDataFrame(e.orderBy("t").toPandas(), e.schema)
    n = 5
    import time

    for i in range(n):
        batch.filter(F.floor(F.col("row_id") * n / 1000) == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return batch, stream


def collect(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def same_rows(a, b):
    columns = sorted(a.columns)
    listed = [f.name for f in a.schema if f.dataType.typeName() == "array"]
    plain = lambda d: d.withColumns({c: F.to_json(c) for c in listed}) if listed else d
    sort = lambda d: plain(d).toPandas()[columns].sort_values(columns).reset_index(drop=True)
    x, y = sort(a), sort(b)
    assert len(x)
    pd.testing.assert_frame_equal(x, y, check_dtype=False)


MACHINES = {
    "cooldown": (lambda: stateful.cooldown("user_id", "bigint", 30000.0), {}),
    "average": (lambda: stateful.exponential_average("user_id", "bigint", 0.3), {}),
    "thermal": (lambda: stateful.thermal_states("user_id", "bigint", 80.0, 20000.0), {"temperature": "value"}),
    "counter": (lambda: stateful.failure_counter("user_id", "bigint"), {"failed": "event_type IN ('error', 'click')"}),
    "link": (lambda: stateful.link_states("user_id", "bigint", window_s=100000.0), {"event": "CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'failure' WHEN 'view' THEN 'success' ELSE 'uploaded' END"}),
    "windows": (lambda: stateful.feature_windows("user_id", "bigint", ["value"], size=20, longest_gap_s=9000.0), {}),
    "evidence": (lambda: stateful.sliding_evidence("user_id", "bigint", 12, 4), {"features": "array(value)", "raw": "event_type"}),
    "anomalies": (lambda: stateful.adaptive_anomalies("user_id", "bigint"), {"n": "100", "mean": "value", "max_delta": "value * 3", "spread": "1D", "recent_delta": "value / 2"}),
}


@pytest.mark.parametrize("name", list(MACHINES))
def test_machine_streams_like_batch(spark, replay, name):
    build, columns = MACHINES[name]
    shaped = [df.withColumns({k: F.expr(v) for k, v in columns.items()}) if columns else df for df in replay]
    machine = build()
    same_rows(
        stateful.run(shaped[0], ["user_id"], machine), collect(spark, streams.stream_machine(shaped[1], ["user_id"], machine), f"m_{name}")
    )


def test_evidence_streams_like_the_native_windows(spark, replay):
    shape = lambda df: df.withColumns({"features": F.array("value"), "raw": F.col("event_type")})
    batch, stream = replay
    whole = ordered.window_evidence(batch, ["user_id"], ["t", "row_id"], ["row_id", "event_type"], 12, 4).select(
        "user_id", F.element_at("evidence", -1)["row_id"].alias("row_id"), F.col("evidence.event_type").alias("evidence")
    )
    machine = stateful.sliding_evidence("user_id", "bigint", 12, 4)
    same_rows(whole, collect(spark, streams.stream_machine(shape(stream), ["user_id"], machine), "m_ev").select("user_id", "row_id", "evidence"))


def test_suppression_streams_like_batch(spark, replay):
    place = {"lat": F.expr("28.6D + (user_id % 12) * 0.0003D"), "lon": F.expr("77.2D + (k % 5) * 0.0002D"), "t": F.col("t") / 200}
    machine = stateful.suppression("event_type", "string")
    batch, stream = (df.withColumns(place) for df in replay)
    same_rows(stateful.run(batch, ["event_type"], machine), collect(spark, streams.stream_machine(stream, ["event_type"], machine), "m_supp"))


def test_validation_streams(spark, replay):
    shape = lambda df: df.select(F.lit("t").alias("topic"), F.to_json(F.struct("event_type", "k")).alias("value"), "ts")
    batch, stream = replay
    keep = ["target", "kind", "body"]
    same_rows(
        validate.fan_out(validate.validate_events(shape(batch))).select(*keep),
        collect(spark, validate.fan_out(validate.validate_events(shape(stream))).select(*keep), "m_fan"),
    )


def test_correlations_stream_like_batch(spark, replay):
    shape = lambda df: df.select(
        "ts", F.concat(F.lit("n"), F.col("user_id") % 5).alias("node_id"), F.col("user_id").alias("sensor_id"), F.col("event_type").alias("anomaly_type"),
        (F.col("k") % 3).cast("int").alias("severity"), (F.col("k") / 100).alias("confidence"),
    )
    batch, stream = (shape(d) for d in replay)
    form = dict(length="6 hours", slide="3 hours")
    whole = streams.windowed_correlations(batch, **form)
    got = collect(spark, streams.windowed_correlations(stream, delay="0 seconds", **form), "m_corr")
    # A window is emitted once the watermark has passed it, so the last windows stay open.
    done = got.agg(F.max("window.end")).first()[0]
    flat = lambda d: d.filter(F.col("window.end") <= F.lit(done)).select(
        F.unix_micros("window.start").alias("s"), "kind", "subject", "parties", "anomaly_count", "severity", F.round("confidence", 9).alias("c")
    )
    same_rows(flat(whole), flat(got))


def test_silence_stream(spark, replay):
    batch, stream = replay
    got = collect(spark, streams.stream_silence(stream.select("user_id", "ts"), "user_id", "bigint", "ts", seconds=40000), "m_sil")
    rows = got.collect()
    assert rows and {r["alert_type"] for r in rows} == {"FEED_UNAVAILABLE"}
    # Every alert stands at a message followed by a silence that long.
    expected = ordered.feed_silences(batch, ["user_id"], ["t", "row_id"], F.col("t"), seconds=40000.0, as_of_s=1e12)
    allowed = {(r["user_id"], int(round(r["t"] * 1e6))) for r in expected.select("user_id", "t").collect()}
    assert {(r["user_id"], r["last_us"]) for r in rows} <= allowed


def test_traces_stream_like_batch(spark, tmp_path):
    import time

    at = pd.Timestamp("2024-01-01", tz="UTC")
    rows = []
    for trace, delays in (("a", [0, 1, 2, 3, 6, 6.5, 7, 7.2, 7.5]), ("b", [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]), ("c", [0, 1])):
        for stage, d in zip(ordered.STAGES, delays):
            rows.append((trace, stage, int((at.timestamp() + d) * 1e9), "DEFECT", float(d) + (70 if trace == "b" and d > 0.4 else 0)))
    rows += [("", ordered.STAGES[0], 1, "x", 0.0), ("a", "unknown", 1, "x", 0.0)]
    spans = spark.createDataFrame(rows, "trace_id string, span_name string, start_ns bigint, alert_type string, arrival_s double")
    batch = ordered.trace_latency(spans)
    assert [(r["trace_id"], r["latency_ms"], r["breach"], r["slowest_stage"]) for r in batch.collect()] == [("a", 7500.0, True, "advisory_emit")]
    timed = spans.withColumn("ts", F.timestamp_micros((F.lit(at.timestamp()) * 1e6 + F.col("arrival_s") * 1e6).cast("bigint"))).drop("arrival_s")
    for low, high in ((-1, 2.5), (2.5, 8), (8, 100)):
        part = timed.filter(F.col("ts").between(F.lit(at + pd.Timedelta(seconds=low)), F.lit(at + pd.Timedelta(seconds=high - 1e-6))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    same_rows(batch, collect(spark, streams.stream_traces(stream), "m_traces"))


def test_deduplication_and_exactly_once(spark, replay, tmp_path):
    _, stream = replay
    twice = stream.withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    once = streams.deduplicated(twice, "row_id", "ts", "1 day")
    for _ in range(2):  # the second run finds nothing new
        q = streams.exactly_once_files(once, f"{tmp_path}/out", f"{tmp_path}/cp", partition_by=["event_type"], every="1 second")
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000


def test_union_of_topics_and_counters(spark, tmp_path):
    for topic in ("a", "b"):
        spark.createDataFrame([("{}", "2024-01-01")], "value string, ts string").write.json(f"{tmp_path}/{topic}")
    paths = {t: f"{tmp_path}/{t}" for t in ("a", "b")}
    assert {r["topic"] for r in feeds.union_topics(spark, paths).collect()} == {"a", "b"}
    listener = streams.IngestCounters()
    spark.streams.addListener(listener)
    try:
        raw = feeds.union_topics(spark, paths, streaming=True)
        seen, _ = feeds.observed(raw, raw, "demo", "1.0.0")
        collect(spark, seen, "m_union")
        import time

        time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals["demo:1.0.0:events:events"] == 2


def test_late_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    on_time, late = streams.late_rows(df, "ts", 10_000_000)
    assert [r["id"] for r in on_time.collect()] == [2] and [r["id"] for r in late.collect()] == [1]
