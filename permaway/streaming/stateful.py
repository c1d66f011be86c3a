"""Streaming forms of the state machines and of the windowed operators.

``event_time_machine`` drives the same step as the batch form on rows in any
order: rows wait in the state until the watermark has passed them, and late ones
come out by themselves. ``stream_machine`` steps rows as they arrive, which gives
the batch rows for input in order only. State is kept per key and lives in the
state store of the query; it survives a restart with the checkpoint.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from permaway.operators.aggregates import correlations
from permaway.operators.ordered import STAGES, slowest_stage
from permaway.operators.stateful import Machine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep large state outside the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_machine(df: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """Streaming form of a machine: the rows of a key in a micro-batch are sorted, then stepped."""
    step, order = machine.step, machine.order

    def advance(key, batches, state: GroupState):
        before = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out, after = step(rows, before)
        state.update((json.dumps(after),))
        yield out

    return df.groupBy(*keys).applyInPandasWithState(
        advance, machine.schema, "state string", "append", GroupStateTimeout.NoTimeout
    )


class EventTimeMachine(StatefulProcessor):
    """Steps a machine over the rows of a key in event time.

    State: ``waiting`` holds rows that the watermark has not passed, ``machine`` what the steps left, ``newest`` the time of the
    last row stepped. A timer stands at the earliest row that waits; when the watermark passes it, all rows up to the
    watermark are sorted and stepped. With ``idle_s`` another timer stands so long after the newest row and
    removes the state of the key.
    """

    def __init__(self, keys: list[str], machine: Machine, columns: StructType, output: list[str], idle_s: float | None) -> None:
        self.keys, self.step, self.order = keys, machine.step, machine.order
        self.columns, self.output, self.idle_s = columns, output, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.machine = handle.getValueState("machine", "state string")
        self.newest = handle.getValueState("newest", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = set()
        for pdf in rows:
            late = [_ms(t) <= passed for t in pdf["t"].tolist()]
            values = _tuples(pdf, self.columns.names)
            fresh = [v for v, x in zip(values, late) if not x]
            if fresh:
                self.waiting.appendList(fresh)
                due.add(min(_ms(t) for t, x in zip(pdf["t"].tolist(), late) if not x))
            if any(late):
                yield self._late(key, [v for v, x in zip(values, late) if x])
        if due:
            self.handle.registerTimer(min(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.waiting.get()), columns=self.columns.names)
        ready = held["t"].map(_ms) <= passed if len(held) else pd.Series(dtype=bool)
        if len(held) and ready.any():
            rows, rest = held[ready].sort_values(self.order, kind="stable").reset_index(drop=True), held[~ready]
            for place, name in enumerate(self.keys):
                rows.insert(place, name, key[place])
            yield from self._stepped(rows)
            self._keep(rest)
            if self.idle_s is not None:
                self.handle.registerTimer(max(self.newest.get()[0] + self._idle_ms() + 1, passed + 1))
        elif self.idle_s is not None and self.newest.exists() and self.newest.get()[0] + self._idle_ms() < passed:
            self.machine.clear()
            self.newest.clear()

    def _idle_ms(self) -> int:
        return math.ceil(self.idle_s * 1000)

    def _stepped(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Step rows in order; after a silence of more than ``idle_s`` from nothing, whether or not the state has gone by then."""
        before = json.loads(self.machine.get()[0]) if self.machine.exists() else None
        times = [_ms(t) for t in rows["t"].tolist()]
        cuts = [0]
        if self.idle_s is not None:
            last = self.newest.get()[0] if self.newest.exists() else times[0]
            cuts += [i for i, (a, b) in enumerate(zip([last, *times], times)) if b - a > self._idle_ms()]
        for low, high in zip(cuts, [*cuts[1:], len(rows)]):
            if high > low:
                out, before = self.step(rows.iloc[low:high], None if low in cuts[1:] else before)
                if len(out):
                    yield out.assign(late=None)[self.output]
        self.machine.update((json.dumps(before),))
        self.newest.update((times[-1],))

    def close(self) -> None:
        pass

    def _keep(self, rest: pd.DataFrame) -> None:
        """The rows that go on waiting, and a timer for the earliest."""
        if not len(rest):
            self.waiting.clear()
            return
        self.waiting.put(_tuples(rest, self.columns.names))
        self.handle.registerTimer(int(rest["t"].map(_ms).min()))

    def _late(self, key, values: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({name: [key[place]] * len(values) for place, name in enumerate(self.keys)})
        out["late"] = [json.dumps(dict(zip(self.columns.names, v)), default=str) for v in values]
        return out.reindex(columns=self.output).astype(object).where(lambda x: x.notna(), None)


def _tuples(pdf: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows of plain Python values, as the state store takes them."""
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return v if isinstance(v, (list, tuple)) or not pd.isna(v) else None

    return [tuple(map(plain, row)) for row in zip(*[pdf[c].tolist() for c in columns])]


def _ms(t: float) -> int:
    """The first millisecond that is not before ``t`` seconds."""
    return math.ceil(round(t * 1e6) / 1000)


def event_time_machine(df: DataFrame, keys: list[str], machine: Machine, ts: str, *, delay: str = "10 seconds", idle_s: float | None = None) -> DataFrame:
    """Streaming form of a machine for rows in any order: the rows of its batch form, as long as none comes later than ``delay``.

    ``ts`` is the row's time stamp, from which the watermark follows, and ``t`` the same time in seconds. The result has the
    machine's columns and ``late``: null, or the row as JSON where it came after the watermark had passed it; late rows are not
    stepped. With ``idle_s``, the state of a key goes when the watermark is so far past its newest row, and the key starts
    anew with its next row; without it, state stays. Rows of a key that wait are those of the last ``delay``.
    """
    use_rocksdb(df.sparkSession)
    parsed = df.sparkSession.createDataFrame([], machine.schema).schema
    columns = StructType([f for f in df.schema.fields if f.name not in (*keys, ts)])
    output = StructType([*(StructField(f.name, f.dataType, True) for f in parsed.fields), StructField("late", StringType())])
    # Spark drops late rows where the operator sees the time stamp itself, so it is left out after the watermark.
    rows = df.withWatermark(ts, delay).select(*keys, *columns.names)
    processor = EventTimeMachine(keys, machine, columns, output.names, idle_s)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "eventTime")


def stream_silence(
    df: DataFrame, key: str, key_type: str, ts: str, *, seconds: int = 10, delay: str = "0 seconds"
) -> DataFrame:
    """One alert per silence of a feed, raised when the watermark passes last message + ``seconds``."""
    def watch(key_value, batches, state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [key_value[0]], "last_us": [last], "alert_type": ["FEED_UNAVAILABLE"]})
            return
        newest = max(int(p["_us"].max()) for p in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: pd.Series([], dtype=object), "last_us": pd.Series([], dtype="int64"), "alert_type": pd.Series([], dtype=object)})

    marked = df.withWatermark(ts, delay).withColumn("_us", F.unix_micros(ts))
    return marked.groupBy(key).applyInPandasWithState(
        watch, f"{key} {key_type}, last_us bigint, alert_type string", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_traces(df: DataFrame, *, ttl_s: int = 60, sla_ms: float = 5000.0, delay: str = "0 seconds") -> DataFrame:
    """Complete traces from spans (trace_id, span_name, start_ns, alert_type, ts).

    A trace completes with its last stage once the first is there; one that
    does not complete within ``ttl_s`` of event time is dropped with its state.
    """
    schema = "trace_id string, alert_type string, starts map<string,bigint>"

    def assemble(key, batches, state: GroupState):
        done = []
        if state.hasTimedOut:
            state.remove()
        else:
            held = json.loads(state.get[0]) if state.exists else None
            rows = pd.concat(list(batches), ignore_index=True).sort_values("_us", kind="stable")
            for name, start, kind, us in zip(rows["span_name"], rows["start_ns"].tolist(), rows["alert_type"], rows["_us"].tolist()):
                if held is not None and us - held["opened"] > ttl_s * 1_000_000:
                    held = None
                if held is None:
                    held = {"opened": us, "kind": "unknown" if pd.isna(kind) else kind, "starts": {}}
                held["starts"][name] = int(start)
                starts = held["starts"]
                if name == STAGES[-1] and starts.get(STAGES[0]) and start:
                    done.append((key[0], held["kind"], starts))
                    held = None
            if held is None:
                if state.exists:
                    state.remove()
            else:
                state.update((json.dumps(held),))
                state.setTimeoutTimestamp(max(held["opened"] // 1000 + ttl_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["trace_id", "alert_type", "starts"])

    known = df.filter(F.col("span_name").isin(STAGES) & (F.col("trace_id") != ""))
    marked = known.withWatermark("ts", delay).withColumn("_us", F.unix_micros("ts"))
    complete = marked.groupBy("trace_id").applyInPandasWithState(
        assemble, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout
    )
    starts = [F.col("starts")[s] for s in STAGES]
    latency = (starts[-1] - starts[0]) / 1_000_000
    return complete.select(
        "trace_id", "alert_type", F.round(latency, 1).alias("latency_ms"), (latency > sla_ms).alias("breach"),
        slowest_stage(starts).alias("slowest_stage"),
    )


def windowed_correlations(df: DataFrame, ts: str = "ts", *, length: str = "5 seconds", slide: str = "1 second", delay: str | None = None) -> DataFrame:
    """Correlated anomalies by trailing window; with ``delay`` the frame is a stream.

    The stream counts distinct parties by two aggregations in a row: first one
    row per window, subject and party, then one per window and subject. Nothing
    is gathered, however many anomalies fall into a window.
    """
    window = F.window(ts, length, slide)
    if delay is None:
        return correlations(df, [window])
    pair = lambda kind, subject, party: F.struct(F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.col(party).cast("string").alias("party"))
    tagged = df.withWatermark(ts, delay).select(
        ts, "severity", "confidence",
        F.explode(F.array(pair("multi_sensor_same_node", "node_id", "sensor_id"), pair("multi_node_same_anomaly", "anomaly_type", "node_id"))).alias("_g"),
    ).select(ts, "severity", "confidence", "_g.*")
    parties = tagged.groupBy(window.alias("window"), "kind", "subject", "party").agg(
        F.count(F.lit(1)).alias("_n"), F.max("severity").alias("_s"), F.sum("confidence").alias("_c")
    )
    grouped = parties.groupBy("window", "kind", "subject").agg(
        F.count(F.lit(1)).alias("parties"), F.sum("_n").alias("anomaly_count"), F.max("_s").alias("_s"), F.sum("_c").alias("_c")
    ).filter("parties >= 2")
    node = F.col("kind") == "multi_sensor_same_node"
    return grouped.select(
        "window", "kind", "subject", "parties", "anomaly_count", F.when(node, F.col("_s")).otherwise(2).cast("int").alias("severity"),
        F.least(F.lit(1.0), F.when(node, F.col("_c") / F.col("anomaly_count") + 0.2).otherwise(F.col("parties") * 0.3)).alias("confidence"),
    )


def deduplicated(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """One row per id within the watermark delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def late_rows(batch: DataFrame, ts: str, watermark_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch on time and late, by the watermark before the batch; for foreachBatch."""
    on_time = F.unix_micros(F.col(ts)) >= watermark_us
    return batch.filter(on_time), batch.filter(~on_time)


def exactly_once_files(df: DataFrame, path: str, checkpoint: str, *, partition_by: list[str], every: str = "30 seconds"):
    """File sink whose commits follow the checkpoint: after a restart no row is lost or written twice."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by).trigger(processingTime=every).outputMode("append").start()
    )


def periodic_check(df: DataFrame, check: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds"):
    """Run a batch check (liveness, limits) on each micro-batch at a fixed pace."""
    return df.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class IngestCounters(StreamingQueryListener):
    """Sums the observed ingest counters of running queries."""

    def __init__(self) -> None:
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            for field, value in row.asDict().items():
                label = f"{name}:{field}"
                self.totals[label] = self.totals.get(label, 0) + int(value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
