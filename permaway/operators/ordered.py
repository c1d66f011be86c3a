"""Ordered logic per key: runs, streaks, gaps, windows, rates, splits.

Everything rests on ordered_scan, so a key of any size is handled; rows are
never gathered per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permaway.functions.scalars import change_hash, key_hash, one_per_key
from permaway.operators.scan import (
    following, last_known, ordered_scan, previous, row_number, running_sum, total,
)
from permaway.session import chunk_count

# Stages of an alert on its way to the screen, in order (fixed values).
STAGES = [
    "sensor_ingest_edge", "kafka_publish", "flink_process", "ml_inference", "advisory_emit",
    "kafka_consume_dt", "digital_twin_render", "websocket_push", "browser_render",
]


def run_position(
    df: DataFrame, keys: list[str], order: list[str], bad: Column, alias: str = "run"
) -> DataFrame:
    """Add the length of the current run of ``bad`` rows (0 on any other row)."""
    flag = F.coalesce(bad, F.lit(False))
    at_reset = F.when(F.col("_bad") == 0, F.col("_upto"))
    runs = ordered_scan(
        df.withColumn("_bad", F.when(flag, 1).otherwise(0)), keys, order,
        [running_sum("_bad", "_upto")], [last_known(at_reset, "_reset")],
    )
    return runs.withColumn(alias, F.when(F.col("_bad") == 1, F.col("_upto") - F.coalesce("_reset", F.lit(0))).otherwise(0)).drop(
        "_bad", "_upto", "_reset"
    )


def failure_runs(
    df: DataFrame, keys: list[str], order: list[str], failed: Column, *, threshold: int = 3
) -> DataFrame:
    """The rows at which a run of failures reaches the threshold; the count then starts again."""
    return run_position(df, keys, order, failed, "run").filter(
        (F.col("run") > 0) & (F.col("run") % threshold == 0)
    )


def dead_letters(fired: DataFrame, *, source: str, payload: str, adapter: str, version: str, threshold: int = 3) -> DataFrame:
    """Alert and dead-letter fields of failure runs, with the payload in hex."""
    raw = F.col(payload).cast("binary")
    return fired.select(
        key_hash(F.col(source), F.col(payload)).alias("event_id"), F.lit("LEGACY_ADAPTER_FAILURE").alias("alert_type"),
        F.lit(adapter).alias("adapter_name"), F.lit(version).alias("adapter_version"), F.col(source).alias("source_id"),
        F.lit(threshold).alias("consecutive_failures"), F.lower(F.hex(raw)).alias("raw_payload_hex"),
        F.octet_length(raw).alias("raw_payload_len"),
    )


def drift_streaks(
    df: DataFrame, keys: list[str], order: list[str], score: str, *, limit: float = 0.2, days: int = 3
) -> DataFrame:
    """Add ``consecutive``, ``warning`` (from the third violation on) and ``alert`` (once per streak)."""
    out = run_position(df, keys, order, F.col(score) >= limit, "consecutive")
    return out.withColumns({"warning": F.col("consecutive") >= days, "alert": F.col("consecutive") == days})


def zone_isolation(
    df: DataFrame, zone: str, order: list[str], restored: Column, *, threshold: int = 3
) -> DataFrame:
    """Add ``alert_count`` since the last restore, ``isolated`` and ``entered`` (once until restored)."""
    out = run_position(df, [zone], order, ~F.coalesce(restored, F.lit(False)), "alert_count")
    return out.withColumns({"isolated": F.col("alert_count") >= threshold, "entered": F.col("alert_count") == threshold})


def headway_pairs(df: DataFrame, segment: str, order: list[str], train: str) -> DataFrame:
    """Consecutive trains on a segment as edges."""
    seen = ordered_scan(df.filter(F.col(segment) != ""), [segment], order, [following(train, "dst")])
    return seen.filter(F.col("dst").isNotNull()).select(segment, F.col(train).alias("src"), "dst")


def following_edges(
    df: DataFrame, keys: list[str], km: str, train: str, *, within: float = 10.0
) -> DataFrame:
    """Edges between neighbouring trains less than ``within`` km apart, weight 1/gap."""
    pair = F.struct(F.col(km).alias("km"), F.col(train).alias("train"))
    seen = ordered_scan(df, keys, [km, train], [previous(pair, "_p")])
    gap = F.col(km) - F.col("_p.km")
    return seen.filter((gap > 0) & (gap < within)).select(
        *keys, F.col("_p.train").alias("src"), F.col(train).alias("dst"), F.lit("follows").alias("type"),
        (1.0 / F.greatest(gap, F.lit(0.1))).alias("weight"),
    )


def trace_latency(spans: DataFrame, *, trace: str = "trace_id", sla_ms: float = 5000.0, ttl_s: float | None = 60.0) -> DataFrame:
    """Complete traces with latency, breach and slowest stage.

    ``spans`` holds trace_id, span_name, start_ns, alert_type and the arrival
    second ``arrival_s``. The first arrival of the last stage after the first
    stage closes a trace, and counts if it comes within the time to live of
    the trace's first arrival; later spans are ignored. Until then a stage
    keeps its latest start. A trace has few spans, so a window over it is bounded.
    """
    known = spans.filter(F.col("span_name").isin(STAGES) & F.col(trace).isNotNull() & (F.col(trace) != ""))
    whole = Window.partitionBy(trace)
    arrival = F.col("arrival_s")
    begun = known.withColumn("_begun", F.min(F.when(F.col("span_name") == STAGES[0], arrival)).over(whole))
    ends = (F.col("span_name") == STAGES[-1]) & (arrival >= F.col("_begun"))
    closing = begun.withColumn("_closing", F.min(F.when(ends, arrival)).over(whole))
    wide = closing.filter(arrival <= F.col("_closing")).groupBy(trace).agg(
        *[F.max_by(F.when(F.col("span_name") == s, F.col("start_ns")), F.when(F.col("span_name") == s, F.col("arrival_s"))).alias(s) for s in STAGES],
        F.min("arrival_s").alias("_opened"),
        F.max("_closing").alias("_closed"),
        F.coalesce(F.min_by("alert_type", "arrival_s"), F.lit("unknown")).alias("alert_type"),
    )
    first, last = F.col(STAGES[0]), F.col(STAGES[-1])
    done = wide.filter((first != 0) & (last != 0))
    if ttl_s is not None:
        done = done.filter(F.col("_closed") - F.col("_opened") <= ttl_s)
    latency = (last - first) / 1_000_000
    return done.select(
        trace, "alert_type", F.round(latency, 1).alias("latency_ms"), (latency > sla_ms).alias("breach"),
        slowest_stage([F.col(s) for s in STAGES]).alias("slowest_stage"),
    )


def slowest_stage(starts: list[Column], names: list[str] = STAGES) -> Column:
    """Stage with the largest positive gap to the present stage before it; the earlier on a tie."""
    before, best_gap, best = starts[0], F.lit(0), F.lit("unknown")
    for start, name in zip(starts[1:], names[1:]):
        gap = F.coalesce(start - before, F.lit(0))
        best = F.when(gap > best_gap, F.lit(name)).otherwise(best)
        best_gap = F.greatest(best_gap, gap)
        before = F.coalesce(start, before)
    return best


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; one aggregation that combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def upsert_merge(df: DataFrame, key: str, order: list[str], updated: list[str]) -> DataFrame:
    """One row per key: ``updated`` fields take the newest present value, the others stay as first seen."""
    place = F.struct(*order)
    rest = [c for c in df.columns if c != key and c not in updated]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in updated]
    first = F.min_by(F.struct(*rest), place).alias("_first")
    return df.groupBy(key).agg(first, *newest).select(key, "_first.*", *updated)


def segment_admission(
    df: DataFrame, segment: str, train: str, order: list[str], *, capacity: Column | int = 1
) -> DataFrame:
    """Add ``accepted``: the train is among the first ``capacity`` different trains of its segment.

    Nothing ever leaves a segment here, so a train is accepted exactly when
    its first arrival ranks within the capacity. A row without a segment is accepted.
    """
    limit = capacity if isinstance(capacity, Column) else F.lit(capacity)
    arrivals = df.groupBy(segment, train).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = ordered_scan(arrivals, [segment], ["_first", train], [row_number("_rank")])
    admitted = ranked.filter(F.col("_rank") <= limit).select(segment, train, F.lit(True).alias("_in"))
    placed = df.join(admitted, [segment, train], "left")
    no_segment = F.coalesce(F.col(segment).cast("string"), F.lit("")) == ""
    return placed.withColumn("accepted", no_segment | F.coalesce("_in", F.lit(False))).withColumn(
        "reason", F.when(~F.col("accepted"), F.concat(F.lit("Segment "), F.col(segment).cast("string"), F.lit(" at capacity")))
    ).drop("_in")


def latest_occupancy(df: DataFrame, segment: str, train: str, order: list[str]) -> DataFrame:
    """Trains per segment counting each train only where it was last seen."""
    return latest_per_key(df, [train], order).groupBy(segment).agg(F.count(F.lit(1)).alias("occupancy"))


def bounded_buffer(
    df: DataFrame, node: str, event_id: str, ts: str, *, size: int = 864_000
) -> DataFrame:
    """Add ``kept``: among the newest ``size`` events of the node; repeated ids count once, the earliest stays."""
    once = one_per_key(df, [node, event_id], [ts])
    seen = ordered_scan(once, [node], [ts, event_id], [row_number("_rank")], descending=True)
    return seen.withColumn("kept", F.col("_rank") <= size).drop("_rank")


def escalation_count(age_s: Column, timeout_s: Column, most: int = 3) -> Column:
    """Escalations due by now: one more each time the age passes the next multiple of the timeout."""
    return F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(age_s / timeout_s) - 1)).cast("int")


# Seconds until escalation by tier (fixed values).
ESCALATION_SECONDS = {1: 300.0, 2: 600.0, 3: 900.0}


def escalation_timeout(tier: Column) -> Column:
    table = F.create_map(*[x for t, s in ESCALATION_SECONDS.items() for x in (F.lit(t), F.lit(s))])
    return F.coalesce(table[tier], F.lit(600.0))


def reliability_flips(df: DataFrame, keys: list[str], order: list[str], reliable: str) -> DataFrame:
    """Rows where the flag changes; before the first row it counts as reliable."""
    seen = ordered_scan(df, keys, order, [previous(reliable, "_was")])
    return seen.filter(F.col(reliable) != F.coalesce("_was", F.lit(True))).drop("_was")


def counter_increase(
    df: DataFrame, keys: list[str], order: list[str], value: str, ts: str, *,
    window: str = "5 minutes", step: str | None = None,
) -> DataFrame:
    """Increase and per-second rate of a counter by window, with resets; a reset adds the new value."""
    seen = ordered_scan(df, keys, order, [previous(value, "_was")])
    delta = F.when(F.col("_was").isNull(), F.lit(0.0)).when(F.col(value) < F.col("_was"), F.col(value)).otherwise(
        F.col(value) - F.col("_was")
    )
    seconds = F.unix_micros(F.col("_w.end")) / 1e6 - F.unix_micros(F.col("_w.start")) / 1e6
    return (
        seen.withColumn("_delta", delta).groupBy(*keys, F.window(ts, window, step or window).alias("_w"))
        .agg(F.sum("_delta").alias("increase"))
        .select(*keys, F.col("_w.start").alias("start"), "increase", (F.col("increase") / seconds).alias("rate"))
    )


def sustained_alerts(
    df: DataFrame, keys: list[str], order: list[str], condition: Column, ts_seconds: Column, hold_s: float
) -> DataFrame:
    """Rows at which the condition has held since ``hold_s`` seconds; first such row of each stretch is ``fired``."""
    on = F.coalesce(condition, F.lit(False))
    base = df.withColumns({"_on": on, "_t": ts_seconds})
    begins = F.when(F.col("_on") & ~F.coalesce("_was", F.lit(False)), F.col("_t"))
    held = ordered_scan(
        base, keys, order, [previous("_on", "_was"), previous("_t", "_pt")], [last_known(begins, "_since")]
    )
    long_enough = F.col("_on") & (F.col("_t") - F.col("_since") >= hold_s)
    before = F.coalesce("_was", F.lit(False)) & (F.col("_pt") - F.col("_since") >= hold_s)
    return held.filter(long_enough).withColumn("fired", ~F.coalesce(before, F.lit(False))).drop("_on", "_t", "_was", "_pt", "_since")


def headway_breaches(
    df: DataFrame, keys: list[str], order: list[str], enter_s: Column, exit_s: Column, *,
    least_s: float = 180.0,
) -> DataFrame:
    """Slots that begin less than ``least_s`` seconds after the slot before them ended, with the ``gap_s``."""
    base = df.withColumns({"_in": enter_s, "_out": exit_s})
    seen = ordered_scan(base, keys, order, [previous("_out", "_p")])
    return seen.withColumn("gap_s", F.col("_in") - F.col("_p")).filter(F.col("gap_s") < least_s).drop("_in", "_out", "_p")


#: Bytes that filled rows come to in one task, were each row of the input filled to the limit, and rows made at once.
FILL_BYTES, FILL_ROWS = 1 << 30, 1 << 15


def gap_fill(
    df: DataFrame, asset: str, ts_s: str, features: list[str], tie: str, *,
    longest_gap_s: float = 300.0, most: int = 1799, window_s: int | None = None,
) -> DataFrame:
    """Readings plus linearly interpolated rows in gaps over ``longest_gap_s``; repeats in time are dropped.

    ``ts_s`` is a numeric column in seconds. The state of the row before is
    taken by one scan; the fill itself makes at most ``most`` rows of a gap. As
    few bytes become many rows, rows are dealt over tasks by what they may become.

    With ``window_s`` the rows are made in the same way, but leave their task added up (see ``_fill_totals``).
    """
    # Of several readings at one time the first stays, as later ones do not move time on.
    once = df.groupBy(asset, ts_s).agg(F.min_by(F.struct(*features), tie).alias("_f"))
    seen = ordered_scan(
        once.withColumn("_now", F.struct(F.col(ts_s).alias("t"), F.col("_f").alias("f"))), [asset], [ts_s],
        [previous("_now", "_p")],
    )
    gap = F.col(ts_s) - F.col("_p.t")
    n = F.when(gap > longest_gap_s, F.least(F.rint(gap).cast("int") - 1, F.lit(most))).otherwise(0)
    counted = seen.withColumn("_n", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))
    dealt = counted.repartition(chunk_count(df, max(FILL_BYTES // max(most, 1), 1)), asset, ts_s)
    if window_s is not None:
        return _fill_totals(dealt, asset, ts_s, features, window_s)
    steps = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n") + 1)).otherwise(F.array(F.lit(1)))
    wide = dealt.withColumn("_step", F.explode(steps))
    filled = F.col("_step") <= F.col("_n")
    alpha = F.col("_step") / (F.col("_n") + 1)
    blend = lambda name: F.when(
        filled, (1 - alpha) * F.col(f"_p.f.{name}") + alpha * F.col(f"_f.{name}")
    ).otherwise(F.col(f"_f.{name}"))
    return wide.select(
        asset, F.when(filled, F.col("_p.t") + F.col("_step") * (gap / (F.col("_n") + 1))).otherwise(F.col(ts_s)).alias(ts_s),
        *[blend(f).alias(f) for f in features], filled.alias("is_interpolated"),
    )


def _fill_totals(dealt: DataFrame, asset: str, ts_s: str, features: list[str], window_s: int) -> DataFrame:
    """Filled rows by window of ``window_s``, added up for each reading: asset, ``window``, ``rows``, ``interpolated``,
    ``offset_s`` (seconds since the window's start) and the sum of each feature.

    A reading gives a row for each window that its own and its filled rows lie in, so windows have several to add up. Nulls
    are left out of sums, and a sum of nulls is null.
    """
    given = dealt.select(
        F.col(asset).alias("asset"), F.col("_n").cast("bigint").alias("n"), F.col("_p.t").cast("double").alias("before"), F.col(ts_s).cast("double").alias("at"),
        *[F.col(f"{side}.{f}").cast("double").alias(f"{tag}{i}") for i, f in enumerate(features) for side, tag in (("_p.f", "p"), ("_f", "f"))],
    )
    kind = given.schema["asset"].dataType.simpleString()
    names = ["asset", "window", "rows", "interpolated", "offset_s", *(f"s{i}" for i in range(len(features)))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            known = lambda name: batch.column(name).is_valid().to_numpy(zero_copy_only=False)
            n, before, at, timed = column("n"), column("before"), column("at"), known("at")
            sides = [(column(f"p{i}"), column(f"f{i}"), known(f"p{i}"), known(f"f{i}")) for i in range(len(features))]
            ends = np.cumsum(n + 1)
            low = 0
            while low < len(n):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + FILL_ROWS, "right")))
                own, count = slice(low, high), n[low:high] + 1
                last = np.cumsum(count) - 1
                first = last - n[own]
                step = np.arange(1.0, last[-1] + 2) - np.repeat(first, count)
                t = np.repeat(before[own], count) + step * np.repeat((at[own] - before[own]) / count, count)
                t[last] = at[own]
                window = np.floor(t / window_s)
                # A piece is a run of rows of one reading in one window; its own row, the last, is not interpolated.
                begins = np.empty(len(t), bool)
                begins[1:] = window[1:] != window[:-1]
                begins[first] = True
                begin = np.flatnonzero(begins)
                owner = np.searchsorted(last, begin)
                rows = np.diff(begin, append=len(t))
                holds_own = begin + rows - 1 == last[owner]
                no_time = ~timed[own][owner]
                sums = []
                with np.errstate(invalid="ignore", over="ignore"):
                    offset = np.add.reduceat(t - window * window_s, begin)
                    alpha = step / np.repeat(count, count)
                    for p, f, has_p, has_f in sides:
                        value = (1 - alpha) * np.repeat(p[own], count) + alpha * np.repeat(f[own], count)
                        value[last] = f[own]
                        # Filled rows lack a value where either side does, own rows where theirs does.
                        blends = (has_p & has_f)[own]
                        if not blends.all():
                            value[np.repeat(~blends, count)] = 0.0
                            value[last] = np.where(has_f[own], f[own], 0.0)
                        has = np.where(holds_own & has_f[own][owner], True, blends[owner] & (rows > holds_own))
                        sums.append(pa.array(np.add.reduceat(value, begin), mask=~has))
                yield pa.RecordBatch.from_arrays([
                    batch.column("asset").take(pa.array(low + owner)), pa.array(np.where(no_time, 0, window[begin]).astype(np.int64), mask=no_time),
                    pa.array(rows), pa.array(rows - holds_own), pa.array(offset, mask=no_time), *sums,
                ], names)
                low = high

    sent = given.mapInArrow(add_up, ", ".join([
        f"asset {kind}", "window bigint", "rows bigint", "interpolated bigint", "offset_s double", *(f"s{i} double" for i in range(len(features))),
    ]))
    return sent.select(F.col("asset").alias(asset), *names[1:5], *[F.col(f"s{i}").alias(f) for i, f in enumerate(features)])


def tumbling_windows(
    df: DataFrame, keys: list[str], order: list[str], size: int = 1800, *, complete: bool = True
) -> DataFrame:
    """Add ``win`` and ``pos``: windows of ``size`` consecutive rows; incomplete ones are dropped."""
    scans = [row_number("_rn")] + ([total(F.lit(1), "_all")] if complete else [])
    seen = ordered_scan(df, keys, order, scans)
    out = seen.withColumns({"win": F.floor((F.col("_rn") - 1) / size), "pos": F.pmod(F.col("_rn") - 1, F.lit(size))})
    if complete:
        out = out.filter((F.col("win") + 1) * size <= F.col("_all")).drop("_all")
    return out.drop("_rn")


def window_quality(windows: DataFrame, keys: list[str], flag: str = "is_interpolated") -> DataFrame:
    """Share of interpolated rows per window in percent."""
    return windows.groupBy(*keys, "win").agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(flag) / F.count(F.lit(1)) * 100).alias("interpolation_pct")
    )


def sliding_windows(
    df: DataFrame, keys: list[str], order: list[str], size: int = 60, step: int = 10
) -> DataFrame:
    """One copy of each row per complete sliding window that holds it: ``win`` and ``pos``."""
    seen = ordered_scan(df, keys, order, [row_number("_rn"), total(F.lit(1), "_all")])
    at = F.col("_rn") - 1
    first = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / step))
    last = F.least(F.floor(at / step), F.floor((F.col("_all") - size) / step))
    wins = F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return seen.withColumn("win", F.explode(wins)).withColumn("pos", at - F.col("win") * step).drop("_rn", "_all")


def window_evidence(
    df: DataFrame, keys: list[str], order: list[str], evidence: list[str], size: int = 60, step: int = 10
) -> DataFrame:
    """Complete sliding windows with their rows in order; a list holds exactly ``size`` rows."""
    held = F.array_sort(F.collect_list(F.struct("pos", *evidence)))
    return sliding_windows(df, keys, order, size, step).groupBy(*keys, "win").agg(
        F.transform(held, lambda h: F.struct(*[h[c].alias(c) for c in evidence])).alias("evidence")
    )


def stale_flags(df: DataFrame, keys: list[str], ts: str, as_of: Column, *, seconds: float = 60.0) -> DataFrame:
    """Age of the newest row per key at ``as_of`` and whether it is over the limit."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("last_seen"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6
    return newest.withColumn("age_s", age).withColumn("stale", F.col("age_s") > seconds)


def stratified_split(
    df: DataFrame, stratum: str, row_id: str, *, seed: int = 42, train: float = 0.8, val: float = 0.1
) -> DataFrame:
    """Add ``split``: train, val or test by a seeded shuffle inside each stratum."""
    shuffled = df.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    seen = ordered_scan(shuffled, [stratum], ["_h", row_id], [row_number("_rn"), total(F.lit(1), "_n")])
    n_train, n_val = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    split = F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test")
    return seen.withColumn("split", split).drop("_h", "_rn", "_n")


def changed_only(df: DataFrame, keys: list[str], order: list[str], state: list[str]) -> DataFrame:
    """Rows whose state differs from the row before; the first row of a key counts as changed."""
    hashed = df.withColumn("_hash", change_hash(*[F.col(s) for s in state]))
    seen = ordered_scan(hashed, keys, order, [previous("_hash", "_was")])
    return seen.filter(~F.col("_hash").eqNullSafe(F.col("_was"))).drop("_hash", "_was")


def feed_silences(
    df: DataFrame, keys: list[str], order: list[str], ts_s: Column, *, seconds: float = 10.0,
    as_of_s: float | Column | None = None,
) -> DataFrame:
    """One row per stretch without messages of at least ``seconds``, up to ``as_of_s`` for the last message."""
    base = df.withColumn("_t", ts_s)
    seen = ordered_scan(base, keys, order, [following("_t", "_n")])
    until = F.col("_n") if as_of_s is None else F.coalesce("_n", as_of_s if isinstance(as_of_s, Column) else F.lit(as_of_s))
    return seen.withColumn("silent_s", until - F.col("_t")).filter(F.col("silent_s") >= seconds).drop("_t", "_n")
