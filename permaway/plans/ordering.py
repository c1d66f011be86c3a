"""Queries on ordered logic, ranking, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from permaway.functions import arrays, physics, scalars
from permaway.functions.risk import delay_interval, risk_score, risk_tier, severity_weight
from permaway.operators import ordered, ranking
from permaway.plans.joining import order_slots
from permaway.plans.registry import EVENTS_SQL, col_map, events, query, table

ORDER = ["ts", "event_id"]
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""
    WITH l AS (SELECT user_id, event_type, arg_max(value, us) AS value, max(us) AS last_us, arg_max(event_id, us) AS event_id FROM {EVENTS_SQL} e GROUP BY 1, 2),
    f AS (SELECT user_id, us, event_type = 'error' AS bad, row_number() OVER {_W} - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM {EVENTS_SQL} e),
    i AS (SELECT user_id, min(us) AS since_us, max(us) AS until_us, count(*) AS run FROM f WHERE bad GROUP BY user_id, island),
    r AS (SELECT user_id, max(us) AS newest FROM {EVENTS_SQL} e GROUP BY user_id)
    SELECT i.user_id, since_us, run, CASE WHEN least(l.value / 25 * 4, 4) >= 3.2 THEN 1 WHEN least(l.value / 25 * 4, 4) >= 2 THEN 2 ELSE 3 END AS tier
    FROM i JOIN r ON i.user_id = r.user_id AND until_us = newest JOIN l ON l.user_id = i.user_id AND l.event_type = 'error'""")
def assets_in_violation(spark, folder):
    """Assets whose newest events are errors: since when, how many, and the risk tier."""
    e = events(spark, folder).select("user_id", "event_id", "event_type", "ts", "us", "value")
    bad = F.col("event_type") == "error"
    runs = ordered.run_position(e, ["user_id"], ORDER, bad, "run")
    begun = ordered.ordered_scan(
        runs.withColumn("_start", F.when(F.col("run") == 1, F.col("us"))), ["user_id"], ORDER, [ordered.last_known("_start", "since_us")]
    )
    newest = ordered.latest_per_key(begun, ["user_id"], ORDER).filter("run > 0")
    score = risk_score(F.col("value") / 25, severity_weight(F.lit("CRITICAL")))
    return newest.select("user_id", "since_us", "run", risk_tier(score).alias("tier"))


@query(f"SELECT user_id, event_type, max(us) AS us, arg_max(value, us) AS value FROM {EVENTS_SQL} e GROUP BY 1, 2")
def latest_state(spark, folder):
    return ordered.latest_per_key(events(spark, folder).select("user_id", "event_type", "us", "event_id", "value"), ["user_id", "event_type"], ["us", "event_id"]).drop("event_id")


@query("""
    SELECT user_id, round(date_diff('microsecond', max(ts), TIMESTAMP '2024-01-30') / 1e6, 3) AS age_s,
      date_diff('microsecond', max(ts), TIMESTAMP '2024-01-30') / 1e6 > 7200 AS stale FROM events GROUP BY user_id""")
def stale_flags(spark, folder):
    out = ordered.stale_flags(events(spark, folder), ["user_id"], "ts", F.lit("2024-01-30").cast("timestamp"), seconds=7200.0)
    return out.select("user_id", F.round("age_s", 3).alias("age_s"), "stale")


@query(f"""
    SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER {_W} AS p FROM events) x WHERE event_type IS DISTINCT FROM p""")
def changed_only(spark, folder):
    return ordered.changed_only(events(spark, folder), ["user_id"], ORDER, ["event_type"]).select("event_id")


@query(f"""
    WITH s AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER {_W} AS run FROM events),
    n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, run, event_type IN ('error', 'click') ORDER BY ts, event_id) AS pos, event_type FROM s)
    SELECT event_id, user_id, pos AS run FROM n WHERE event_type IN ('error', 'click') AND pos % 3 = 0""")
def failure_runs(spark, folder):
    failed = F.col("event_type").isin("error", "click")
    return ordered.failure_runs(events(spark, folder), ["user_id"], ORDER, failed).select("event_id", "user_id", "run")


@query(f"""
    WITH s AS (SELECT *, sum(CASE WHEN value >= 40 THEN 0 ELSE 1 END) OVER {_W} AS run FROM events),
    n AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id, run, value >= 40 ORDER BY ts, event_id) AS pos FROM s)
    SELECT event_id, CASE WHEN value >= 40 THEN pos ELSE 0 END AS consecutive, value >= 40 AND pos >= 3 AS warning, value >= 40 AND pos = 3 AS alert FROM n""")
def drift_streaks(spark, folder):
    out = ordered.drift_streaks(events(spark, folder), ["user_id"], ORDER, "value", limit=40.0)
    return out.select("event_id", "consecutive", "warning", "alert")


@query("""
    WITH z AS (SELECT *, user_id % 4 AS zone, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS run FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY zone, run ORDER BY ts, event_id) AS alert_count FROM z WHERE event_type <> 'signup' QUALIFY alert_count = 3""")
def zone_isolation(spark, folder):
    e = events(spark, folder).withColumn("zone", F.col("user_id") % 4)
    out = ordered.zone_isolation(e, "zone", ORDER, F.col("event_type") == "signup").filter("entered").select("event_id", "alert_count")
    return out


@query(f"""
    WITH s AS (SELECT enter, id, train, segment, lead(train) OVER (PARTITION BY segment ORDER BY enter, id) AS dst FROM
      (SELECT o_orderkey AS id, o_orderpriority || o_orderstatus AS segment, o_custkey AS train, o_orderdate AS enter FROM orders) x)
    SELECT segment, train AS src, dst FROM s WHERE dst IS NOT NULL""")
def headway_pairs(spark, folder):
    out = ordered.headway_pairs(order_slots(spark, folder), "segmentId", ["enterAt", "slot_id"], "trainId")
    return out.withColumnRenamed("segmentId", "segment")


@query("""
    WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal / 50 AS km, lag(c_acctbal / 50) OVER w AS pk, lag(c_custkey) OVER w AS pid FROM customer
      WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))
    SELECT c_nationkey, pid AS src, c_custkey AS dst, round(1 / greatest(km - pk, 0.1), 6) AS weight FROM s WHERE km - pk > 0 AND km - pk < 10""")
def following_edges(spark, folder):
    c = table(spark, folder, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 50).alias("km"))
    out = ordered.following_edges(c, ["c_nationkey"], "km", "c_custkey")
    return out.select("c_nationkey", "src", "dst", F.round("weight", 6).alias("weight"))


@query("""
    WITH s AS (SELECT o_orderkey AS id, o_custkey AS c, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(o_orderdate) / 1e6 + (o_orderkey % 3) * 432000 AS z FROM orders),
    g AS (SELECT id, a - lag(z) OVER (PARTITION BY c ORDER BY a, id) AS gap FROM s)
    SELECT id AS slot_id, gap AS gap_s FROM g WHERE gap < 180""")
def headway_breach(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("slot_id"), "o_custkey", (F.unix_micros("o_orderdate") / 1e6).alias("start_s"))
    leave = F.col("start_s") + (F.col("slot_id") % 3) * 432000
    return ordered.headway_breaches(o, ["o_custkey"], ["start_s", "slot_id"], F.col("start_s"), leave).select("slot_id", "gap_s")


_SPANS = """(SELECT l_orderkey AS trace, CASE l_linenumber WHEN 1 THEN 0 WHEN 7 THEN 8 ELSE l_linenumber - 1 END AS stage, l_linenumber,
    l_suppkey * 100000000 + l_partkey * 1000 + l_linenumber::BIGINT * 1500000000 AS start_ns, l_quantity + l_partkey / 10000.0 AS arrival FROM lineitem)"""


@query(f"""
    WITH b AS (SELECT trace, min(arrival) AS opened, min(arrival) FILTER (WHERE stage = 0) AS begun FROM {_SPANS} x GROUP BY trace),
    c AS (SELECT trace, min(arrival) AS closing FROM {_SPANS} x JOIN b USING (trace) WHERE stage = 8 AND arrival >= begun GROUP BY trace),
    s AS (SELECT trace, stage, arg_max(start_ns, arrival) AS start_ns FROM {_SPANS} x JOIN b USING (trace) JOIN c USING (trace)
      WHERE arrival <= closing AND closing - opened <= 60 GROUP BY trace, stage),
    t AS (SELECT trace, max(start_ns) FILTER (WHERE stage = 0) AS a, max(start_ns) FILTER (WHERE stage = 8) AS z FROM s GROUP BY trace),
    g AS (SELECT trace, stage, start_ns - lag(start_ns) OVER (PARTITION BY trace ORDER BY stage) AS gap FROM s),
    m AS (SELECT trace, stage, row_number() OVER (PARTITION BY trace ORDER BY gap DESC, stage) AS r FROM g WHERE gap > 0)
    SELECT t.trace AS trace_id, round((z - a) / 1e6, 1) AS latency_ms, (z - a) / 1e6 > 5000 AS breach,
      CASE m.stage WHEN 1 THEN 'kafka_publish' WHEN 2 THEN 'flink_process' WHEN 3 THEN 'ml_inference' WHEN 4 THEN 'advisory_emit' WHEN 5 THEN 'kafka_consume_dt'
        WHEN 8 THEN 'browser_render' ELSE 'unknown' END AS slowest_stage
    FROM t LEFT JOIN m ON m.trace = t.trace AND m.r = 1 WHERE a IS NOT NULL AND z IS NOT NULL""")
def trace_latency(spark, folder):
    number = F.col("l_linenumber")
    stage = F.when(number == 1, 0).when(number == 7, 8).otherwise(number - 1)
    spans = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("trace_id"), F.get(F.array(*[F.lit(s) for s in ordered.STAGES]), stage).alias("span_name"),
        (F.col("l_suppkey") * 100000000 + F.col("l_partkey") * 1000 + number.cast("bigint") * 1500000000).alias("start_ns"),
        F.lit("t").alias("alert_type"), (F.col("l_quantity") + F.col("l_partkey") / 10000.0).alias("arrival_s"),
    )
    out = ordered.trace_latency(spans)
    return out.select(F.col("trace_id").cast("bigint").alias("trace_id"), "latency_ms", "breach", "slowest_stage")


@query(f"""
    SELECT user_id, arg_min(event_type, us) AS event_type, arg_min(event_id, us) AS event_id,
      arg_max(value, us) FILTER (WHERE value < 50) AS value, arg_max(k, us) FILTER (WHERE k % 2 = 0) AS k FROM {EVENTS_SQL} e GROUP BY user_id""")
def upsert_merge(spark, folder):
    e = events(spark, folder).select(
        "user_id", "us", "event_id", "event_type", F.when(F.col("value") < 50, F.col("value")).alias("value"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("k")
    )
    return ordered.upsert_merge(e, "user_id", ["us", "event_id"], ["value", "k"]).drop("us")


@query(f"""
    WITH a AS (SELECT k, user_id, min(us) AS first FROM {EVENTS_SQL} e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first, user_id) AS r FROM a)
    SELECT event_id, r <= 2 AS accepted FROM {EVENTS_SQL} e JOIN r USING (k, user_id)""")
def segment_admission(spark, folder):
    return ordered.segment_admission(events(spark, folder), "k", "user_id", ["us"], capacity=2).select("event_id", "accepted")


@query(f"SELECT k AS segment, count(*) AS occupancy FROM (SELECT user_id, arg_max(k, us) AS k FROM {EVENTS_SQL} e GROUP BY user_id) x GROUP BY k")
def latest_occupancy(spark, folder):
    e = events(spark, folder).select("user_id", "k", "us", "event_id")
    return ordered.latest_occupancy(e, "k", "user_id", ["us", "event_id"]).withColumnRenamed("k", "segment")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40 AS kept FROM events")
def bounded_buffer(spark, folder):
    e = events(spark, folder)
    return ordered.bounded_buffer(e.unionByName(e), "user_id", "event_id", "ts", size=40).select("event_id", "kept")


@query(f"""
    SELECT event_id, CAST(least(3, greatest(0, ceil(age / CASE 1 + user_id % 3 WHEN 1 THEN 300.0 WHEN 2 THEN 600.0 ELSE 900.0 END) - 1)) AS INTEGER) AS escalations
    FROM (SELECT *, value * 20 AS age FROM {EVENTS_SQL} e) e""")
def escalations(spark, folder):
    timeout = ordered.escalation_timeout((1 + F.col("user_id") % 3).cast("int"))
    return events(spark, folder).select("event_id", ordered.escalation_count(F.col("value") * 20, timeout).alias("escalations"))


@query(f"""
    SELECT event_id FROM (SELECT event_id, event_type <> 'error' AS ok, coalesce(lag(event_type <> 'error') OVER {_W}, TRUE) AS was FROM events) x WHERE ok <> was""")
def reliability_flips(spark, folder):
    e = events(spark, folder).withColumn("reliable", F.col("event_type") != "error")
    return ordered.reliability_flips(e, ["user_id"], ORDER, "reliable").select("event_id")


@query(f"""
    WITH d AS (SELECT user_id, us, k, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {EVENTS_SQL} e)
    SELECT user_id, us // 86400000000 * 86400000000 AS start_us, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END) AS DOUBLE) AS increase,
      round(sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END) / 86400.0, 8) AS rate FROM d GROUP BY user_id, us // 86400000000""")
def counter_rate(spark, folder):
    out = ordered.counter_increase(events(spark, folder), ["user_id"], ORDER, "k", "ts", window="1 day")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.col("increase").cast("double").alias("increase"), F.round("rate", 8).alias("rate"))


@query(f"""
    WITH i AS (SELECT *, value > 30 AS hot, row_number() OVER {_W} - row_number() OVER (PARTITION BY user_id, value > 30 ORDER BY ts, event_id) AS g FROM {EVENTS_SQL} e),
    s AS (SELECT *, us - min(us) OVER (PARTITION BY user_id, hot, g) AS held FROM i WHERE hot),
    f AS (SELECT event_id, held, row_number() OVER (PARTITION BY user_id, g ORDER BY us, event_id) AS r, us, user_id, g FROM s WHERE held >= 21600000000)
    SELECT event_id, r = 1 AS fired FROM f""")
def sustained_alerts(spark, folder):
    out = ordered.sustained_alerts(events(spark, folder), ["user_id"], ORDER, F.col("value") > 30, F.col("us") / 1e6, 21600.0)
    return out.select("event_id", "fired")


@query(f"""
    WITH p AS (SELECT user_id, us / 1e6 AS t, value, lag(us / 1e6) OVER (PARTITION BY user_id ORDER BY us) AS pt, lag(value) OVER (PARTITION BY user_id ORDER BY us) AS pv FROM {EVENTS_SQL} e),
    n AS (SELECT *, CASE WHEN t - pt > 300 THEN least(CAST(round_even(t - pt, 0) AS BIGINT) - 1, 1799) ELSE 0 END AS n FROM p),
    f AS (SELECT user_id, t, value, FALSE AS is_interpolated FROM n
      UNION ALL SELECT user_id, pt + i * ((t - pt) / (n + 1)), (1 - i / (n + 1)) * pv + i / (n + 1) * value, TRUE FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n WHERE n > 0) u)
    SELECT user_id, is_interpolated, count(*) AS rows, round(min(t), 3) AS first, round(max(t), 3) AS last, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(avg(value), 6) AS mean
    FROM f GROUP BY 1, 2""")
def gap_fill(spark, folder):
    """Every gap filled up to the operator's own limit: what each asset's own and filled readings come to."""
    e = events(spark, folder).select("user_id", (F.col("us") / 1e6).alias("t"), "value", "event_id")
    out = ordered.gap_fill(e, "user_id", "t", ["value"], "event_id")
    digits = lambda c, n, name: F.round(c, n).alias(name)
    return out.groupBy("user_id", "is_interpolated").agg(
        F.count(F.lit(1)).alias("rows"), digits(F.min("t"), 3, "first"), digits(F.max("t"), 3, "last"),
        digits(F.min("value"), 6, "lowest"), digits(F.max("value"), 6, "highest"), digits(F.avg("value"), 6, "mean"),
    )


@query(f"""
    WITH o AS (SELECT user_id, us / 1e6 AS t, arg_min(value, event_id) AS value FROM {EVENTS_SQL} e GROUP BY 1, 2),
    p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pt, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS pv FROM o),
    n AS (SELECT *, CASE WHEN t - pt > 300 THEN least(CAST(round_even(t - pt, 0) AS BIGINT) - 1, 1799) ELSE 0 END AS n FROM p),
    f AS (SELECT user_id, t, value, FALSE AS filled FROM n
      UNION ALL SELECT user_id, pt + i * ((t - pt) / (n + 1)), (1 - i / (n + 1)) * pv + i / (n + 1) * value, TRUE
        FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n WHERE n > 0) u)
    SELECT user_id, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS rows, count(*) FILTER (WHERE filled) AS interpolated,
      round(sum(t - floor(t / 3600) * 3600), 3) AS offset_s, round(sum(value), 6) AS total FROM f GROUP BY 1, 2""")
def gap_fill_hours(spark, folder):
    """Every gap filled up to the operator's own limit; the filled rows are added up by asset and hour."""
    e = events(spark, folder).select("user_id", (F.col("us") / 1e6).alias("t"), "value", "event_id")
    filled = ordered.gap_fill(e, "user_id", "t", ["value"], "event_id", window_s=3600).withColumnRenamed("window", "hour")
    return filled.groupBy("user_id", "hour").agg(
        F.sum("rows").alias("rows"), F.sum("interpolated").alias("interpolated"),
        F.round(F.sum("offset_s"), 3).alias("offset_s"), F.round(F.sum("value"), 6).alias("total"),
    )


@query(f"""
    WITH r AS (SELECT *, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {EVENTS_SQL} e)
    SELECT user_id, i // 25 AS win, count(*) AS rows, round(count(*) FILTER (WHERE k % 4 = 0) / count(*) * 100, 6) AS interpolation_pct FROM r
    WHERE (i // 25 + 1) * 25 <= n GROUP BY 1, 2""")
def count_windows(spark, folder):
    e = events(spark, folder).withColumn("is_interpolated", F.col("k") % 4 == 0)
    windows = ordered.tumbling_windows(e, ["user_id"], ORDER, 25)
    return ordered.window_quality(windows, ["user_id"]).withColumn("interpolation_pct", F.round("interpolation_pct", 6))


@query(f"""
    WITH r AS (SELECT user_id, value, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT *, unnest(range(0, n - 30 + 1, 10)) AS o FROM r)
    SELECT user_id, o // 10 AS win, count(*) AS rows, round(sum(value), 4) AS total FROM w WHERE i BETWEEN o AND o + 29 GROUP BY 1, 2""")
def sliding_windows(spark, folder):
    wins = ordered.sliding_windows(events(spark, folder), ["user_id"], ORDER, 30, 10)
    return wins.groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    SELECT source, count(*) AS images, CAST(floor(count(*) * 0.8) AS BIGINT) AS train, CAST(floor(count(*) * 0.1) AS BIGINT) AS val,
      CAST(count(*) - floor(count(*) * 0.8) - floor(count(*) * 0.1) AS BIGINT) AS test FROM documents GROUP BY source""")
def stratified_split(spark, folder):
    d = ordered.stratified_split(table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id")
    part = lambda s: F.count_if(F.col("split") == s).alias(s)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("images"), part("train"), part("val"), part("test"))


@query(f"""
    SELECT event_id, nxt - us AS silent_us FROM (SELECT event_id, us, lead(us) OVER {_W} AS nxt FROM {EVENTS_SQL} e) x WHERE nxt - us >= 21600000000""")
def feed_silence(spark, folder):
    out = ordered.feed_silences(events(spark, folder), ["user_id"], ORDER, F.col("us"), seconds=21600e6)
    return out.select("event_id", F.col("silent_s").alias("silent_us"))


# Ranking and sets


@query("""
    SELECT event_id AS advisory_id, CAST(round_even(value * 10, 0) AS BIGINT) AS age_s,
      greatest(0, CAST(round_even(CASE 1 + user_id % 3 WHEN 1 THEN 300.0 WHEN 2 THEN 600.0 ELSE 900.0 END - value * 10, 0) AS BIGINT)) AS to_escalation_s
    FROM events ORDER BY value DESC, event_id""")
def queue_order(spark, folder):
    e = events(spark, folder).select(
        F.col("event_id").alias("advisory_id"), F.col("value").alias("risk_score"), (1 + F.col("user_id") % 3).cast("int").alias("risk_tier"), (F.col("value") * 10).alias("age")
    )
    return ranking.advisory_queue(e, F.col("age"), F.lit(0.0)).select("advisory_id", "age_s", "to_escalation_s")


@query("""
    SELECT event_id, CAST(r AS INTEGER) AS severity_rank, (SELECT count(*) FROM events) - 5 AS remaining FROM (
      SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS r FROM events) x ORDER BY r, event_id LIMIT 5""")
def top_pending(spark, folder):
    e = events(spark, folder).select("event_id", F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "click", "HIGH").when(F.col("event_type") == "view", "MEDIUM").alias("severity"))
    return ranking.top_pending(e, "event_id").select("event_id", "severity_rank", "remaining")


@query("""
    SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) x
    UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def newest_per_subsystem(spark, folder):
    o = table(spark, folder, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    last = ranking.newest(o, "o_orderdate", "o_orderkey", 100).select("o_orderkey")
    return last.unionByName(ranking.newest(o, "o_orderdate", "o_orderkey", where=urgent).select("o_orderkey"))


@query("""
    SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'A') ORDER BY ts, event_id LIMIT 100""")
def oldest_unacked(spark, folder):
    acked = table(spark, folder, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("event_id")).distinct()
    return ranking.oldest_unacked(events(spark, folder), acked, "event_id", "ts").select("event_id")


@query("""
    SELECT event_id, CAST(queue AS INTEGER) AS queue, place FROM (SELECT event_id, CASE WHEN user_id % 6 < 4 THEN user_id % 6 ELSE 2 END AS queue,
      row_number() OVER (PARTITION BY CASE WHEN user_id % 6 < 4 THEN user_id % 6 ELSE 2 END ORDER BY ts, event_id) AS place FROM events) x
    WHERE place <= CASE queue WHEN 0 THEN 100 WHEN 1 THEN 200 ELSE 500 END""")
def capped_priority(spark, folder):
    e = events(spark, folder).withColumn("priority", (F.col("user_id") % 6).cast("int"))
    return ranking.capped_queue(e, "priority", ORDER).select("event_id", "queue", F.col("place").cast("bigint").alias("place"))


@query("""
    WITH n AS (SELECT s_suppkey, s_nationkey, s_suppkey % 11 / 10.0 * 20 - CASE WHEN s_nationkey * 4 > 75 THEN (s_nationkey * 4 - 75) * 2 ELSE 0 END + (4 - s_suppkey % 4) * 5 AS cold FROM supplier),
    j AS (SELECT c_custkey, s_suppkey, cold + CASE WHEN c_nationkey = s_nationkey THEN 50 ELSE 0 END AS score FROM customer, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS r FROM j)
    SELECT c_custkey, s_suppkey AS node_id, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE r = 1""")
def node_rank(spark, folder):
    requests = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("model"))
    nodes = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("node_id"), F.array("s_nationkey").alias("loaded"), (F.col("s_suppkey") % 11 / 10.0).alias("used"),
        (F.col("s_nationkey") * 4).alias("temperature_c"), F.lit(4).alias("slots"), (F.col("s_suppkey") % 4).alias("workloads"),
    )
    return ranking.best_nodes(requests, nodes).select("c_custkey", "node_id", F.round("score", 6).alias("score"))


@query("""
    SELECT event_type, user_id, count(*) AS alerts, least(count(*), 10) AS sent, min(event_id) AS first_id FROM events GROUP BY 1, 2""")
def alert_groups(spark, folder):
    out = ranking.alert_groups(events(spark, folder), ["event_type", "user_id"], ["event_id"])
    return out.select("event_type", "user_id", "alerts", F.size("sent").cast("bigint").alias("sent"), F.get("sent", 0)["event_id"].alias("first_id"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#17'")
def version_lookup(spark, folder):
    return ranking.point_lookup(table(spark, folder, "part"), "p_brand", "Brand#17").select("p_partkey", "p_name")


@query("SELECT n_name AS id FROM nation WHERE n_name <> 'NATION_1' ORDER BY n_nationkey LIMIT 5")
def route_order(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("seg_order"))
    return ranking.route_segments(n, "NATION_1").select("id")


@query("SELECT event_type AS kind, event_id AS id, value AS count FROM events WHERE event_type = 'error' UNION ALL SELECT 'advisory', o_orderkey, NULL FROM orders")
def active_alerts(spark, folder):
    defects = events(spark, folder).filter("event_type = 'error'").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("count"))
    return ranking.active_alerts(defects, table(spark, folder, "orders").select(F.lit("advisory").alias("kind"), F.col("o_orderkey").alias("id")))


@query("SELECT DISTINCT p_size AS class FROM part WHERE p_size NOT IN (SELECT s_nationkey FROM supplier)")
def missing_classes(spark, folder):
    expected = table(spark, folder, "part").select(F.col("p_size").alias("class"))
    return ranking.missing_classes(expected, table(spark, folder, "supplier").select(F.col("s_nationkey").alias("class")))


@query("""
    WITH e AS (SELECT DISTINCT o_orderpriority AS round_id, o_custkey AS client FROM orders), s AS (SELECT DISTINCT o_orderpriority AS round_id, o_custkey AS client FROM orders WHERE o_totalprice > 400000)
    SELECT e.round_id, count(s.client) AS submitted, count(*) - count(s.client) AS absent, count(s.client) < 200 AS aborted FROM e LEFT JOIN s USING (round_id, client) GROUP BY e.round_id""")
def round_attendance(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("round_id"), F.col("o_custkey").alias("client"), "o_totalprice")
    return ranking.round_attendance(o, o.filter("o_totalprice > 400000"), least=200)


@query("""
    SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""")
def first_by_id(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return ranking.first_by_id(o, "o_custkey", ["o_orderkey"])


# Scalar functions


@query(f"""
    SELECT event_id, 'a-' || user_id AS asset, lower(hex(event_type)) AS hex_type, sha256('x::' || event_id) AS key,
      lpad(CAST((k * 31 // 60) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k * 31 % 60 AS VARCHAR), 2, '0') || ':00' AS clock,
      CAST(dayofweek(ts) AS INTEGER) AS weekday, k * 1500 / 1000.0::DOUBLE AS ms, epoch_us(CASE WHEN k % 2 = 0 THEN date_trunc('second', ts) ELSE ts END) AS parsed_us
    FROM {EVENTS_SQL} e""")
def text_and_time(spark, folder):
    iso = F.when(F.col("k") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a time")
    return events(spark, folder).select(
        "event_id", scalars.prefixed_id("a", F.col("user_id")).alias("asset"), scalars.hex_payload(F.encode("event_type", "UTF-8")).alias("hex_type"),
        scalars.key_hash(F.lit("x"), F.col("event_id")).alias("key"), scalars.minutes_to_clock(F.col("k") * 31).alias("clock"),
        scalars.weekday_from_sunday(F.col("ts")).alias("weekday"), scalars.nanos_between_ms(F.lit(0), F.col("k") * 1500000).alias("ms"),
        F.unix_micros(scalars.iso_timestamp(iso, F.col("ts"))).alias("parsed_us"),
    )


_MU = f"""(SELECT event_id, user_id, v, vib, hum, CASE WHEN vib > 4 THEN 0.40 WHEN vib > 3 THEN 0.30 WHEN vib > 2 OR hum > 85 THEN 0.25 WHEN hum > 70 THEN 0.20 ELSE 0.15 END AS ks,
    CASE WHEN vib > 4 THEN 0.08 WHEN vib > 3 THEN 0.12 WHEN vib > 2 OR hum > 85 THEN 0.18 WHEN hum > 70 THEN 0.25 ELSE 0.35 END AS mu0
    FROM (SELECT event_id, user_id, CAST(k AS DOUBLE) * 1.6 AS v, value / 30 AS vib, CAST(user_id % 100 AS DOUBLE) AS hum FROM {EVENTS_SQL} e) x)"""


@query(f"""
    SELECT event_id, round(greatest(0.02, least(0.40, mu0 * (1 - ks * (1 - exp(-greatest(v / 3.6, 0.1) / 25))) * greatest(0, 1 - 0.03 * greatest(0, vib - 1)))), 6) AS mu FROM {_MU} m""")
def adhesion(spark, folder):
    mu = physics.adhesion(F.col("k") * 1.6, F.col("value") / 30, F.col("user_id") % 100)
    return events(spark, folder).select("event_id", F.round(mu, 6).alias("mu"))


@query(f"""
    SELECT event_id, round(v / 3.6 * 3 + v / 3.6 * 7 * 0.9 + power(v / 3.6, 2) * 1.04 / (2 * 0.08 * 9.81 * 0.7), 4) AS certified_m,
      round(1.5 + 0.0075 * v + 0.00014 * (12.5 / (580 / 260.0)) * v * v, 6) AS resistance, round(0.5 * 1.225 * 0.45 * 12.5 * power(v / 3.6, 2), 4) AS drag,
      round(greatest(0.5, least(1, 1 - 0.15 * 1.025 * (1 - exp(-power(v / 3.6, 2) * (k + 1) / 50000)))), 6) AS fade,
      round(CASE WHEN k % 2 = 0 THEN 700.0 / (k + 1) ELSE 0 END, 6) AS curve FROM (SELECT *, k * 1.6 AS v FROM {EVENTS_SQL} e) e""")
def certified_distance(spark, folder):
    v = F.col("k") * 1.6
    return events(spark, folder).select(
        "event_id", F.round(physics.certified_distance(v), 4).alias("certified_m"), F.round(physics.running_resistance(v, 580.0, 260.0, 12.5), 6).alias("resistance"),
        F.round(physics.air_drag(v, 12.5), 4).alias("drag"), F.round(physics.brake_fade(v, F.col("k") + 1), 6).alias("fade"),
        F.round(physics.curve_resistance(F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(-1)), 6).alias("curve"),
    )


@query(f"""
    SELECT event_id, round(4 * hz * (1 - 0.24), 6) AS bpfo, round(4 * hz * 1.24, 6) AS bpfi, round(50 / 24.0 * hz * (1 - power(0.24, 2)), 6) AS bsf, round(hz / 2 * 0.76, 6) AS ftf
    FROM (SELECT event_id, value * 10 / 60 AS hz FROM events) e""")
def bearing_frequencies(spark, folder):
    f = physics.bearing_frequencies(F.col("value") * 10)
    return events(spark, folder).select("event_id", *[F.round(f[n], 6).alias(n) for n in ("bpfo", "bpfi", "bsf", "ftf")])


@query("""SELECT event_id, round(value, 2) AS point, round(value - 5, 2) AS lower, round(value + 5, 2) AS upper FROM events""")
def delay_intervals(spark, folder):
    return events(spark, folder).select("event_id", delay_interval(F.col("value")).alias("i")).select("event_id", "i.*")


@query("""
    SELECT vec_id, round(greatest(-0.2, least(0.2, x + 0.1 * sign(y))), 6) AS moved, round(greatest(a, b, c), 4) AS confidence, round(a, 4) AS defect_prob,
      round((a - b) / sqrt(2), 6) AS detail0, round(CASE WHEN vec_id % 2 = 0 THEN x ELSE 0 END, 6) AS padded FROM (
      SELECT vec_id, CAST(embedding[5] AS DOUBLE) AS x, CAST(embedding[6] AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings) e""")
def vector_functions(spark, folder):
    e = table(spark, folder, "embeddings").withColumn("g", F.col("embedding").cast("array<double>"))
    gradient = F.concat(F.slice("g", 2, 63), F.slice("g", 1, 1))
    moved = arrays.sign_step(F.col("g"), gradient, 0.1, F.lit(-0.2), F.lit(0.2))
    outputs = F.slice("g", 1, 3)
    cut = F.when(F.col("vec_id") % 2 == 0, F.slice("g", 1, 5)).otherwise(F.slice("g", 1, 4))
    return e.select(
        "vec_id", F.round(F.get(moved, 4), 6).alias("moved"), arrays.output_confidence(outputs).alias("confidence"),
        arrays.named_outputs(outputs)["defect_prob"].alias("defect_prob"), F.round(F.get(arrays.haar_step(F.col("g"))["detail"], 0), 6).alias("detail0"),
        F.round(F.get(arrays.fit_length(cut, 8), 4), 6).alias("padded"),
    )
