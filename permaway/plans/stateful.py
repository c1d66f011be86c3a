"""Queries on state machines, signal windows, braking and the corridor graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from permaway.functions import scalars
from permaway.operators import aggregates, braking, federated, graph, ordered, signal, stateful
from permaway.plans.registry import EVENTS_SQL, col_map, events, query, table
from permaway.session import durable
from permaway.sources import corridor

# Events per user with their number, the input of the recursive SQL below.
_R = f"(SELECT user_id, event_id, event_type, value, k, us / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {EVENTS_SQL} e)"


def readings(spark, folder):
    return events(spark, folder).select(
        "user_id", F.col("event_id").alias("row_id"), (F.col("us") / 1e6).alias("t"), "value", "event_type", "k"
    )


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, t AS last, TRUE AS fired FROM r WHERE rn = 1
      UNION ALL SELECT r.user_id, r.rn, r.event_id, CASE WHEN r.t >= s.last + 30000 THEN r.t ELSE s.last END, r.t >= s.last + 30000 FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
    SELECT user_id, event_id AS row_id FROM s WHERE fired""")
def cooldown_alerts(spark, folder):
    return stateful.run(readings(spark, folder), ["user_id"], stateful.cooldown("user_id", "bigint", 30000.0)).select("user_id", "row_id")


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, value > 80 AS active, CAST(NULL AS DOUBLE) AS since, CASE WHEN value > 80 THEN 'THERMAL_PROTECTION_ACTIVE' END AS alert FROM r WHERE rn = 1
      UNION ALL SELECT r.user_id, r.rn, r.event_id,
        CASE WHEN r.value > 80 THEN TRUE WHEN s.active AND s.since IS NOT NULL AND r.t - s.since >= 20000 THEN FALSE ELSE s.active END,
        CASE WHEN r.value > 80 THEN NULL WHEN s.active AND s.since IS NULL THEN r.t WHEN s.active AND r.t - s.since >= 20000 THEN NULL ELSE s.since END,
        CASE WHEN r.value > 80 AND NOT s.active THEN 'THERMAL_PROTECTION_ACTIVE' WHEN r.value <= 80 AND s.active AND s.since IS NOT NULL AND r.t - s.since >= 20000 THEN 'THERMAL_PROTECTION_LIFTED' END
      FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
    SELECT user_id, event_id AS row_id, alert AS alert_type FROM s WHERE alert IS NOT NULL""")
def thermal_states(spark, folder):
    e = readings(spark, folder).withColumnRenamed("value", "temperature")
    return stateful.run(e, ["user_id"], stateful.thermal_states("user_id", "bigint", 80.0, 20000.0)).drop("t")


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, 'CONNECTED' AS state, 'CONNECTED' AS before, CASE WHEN event_type IN ('error', 'click') THEN [t] ELSE [] END AS fails FROM r WHERE rn = 1
      UNION ALL SELECT user_id, rn, event_id, CASE WHEN good AND state = 'AUTONOMOUS' THEN 'RECONNECTING' WHEN bad AND state = 'CONNECTED' AND len(f) >= 3 THEN 'AUTONOMOUS'
          WHEN NOT good AND NOT bad AND state = 'RECONNECTING' THEN 'CONNECTED' ELSE state END, state, f FROM (
        SELECT r.user_id, r.rn, r.event_id, s.state, r.event_type = 'view' AS good, r.event_type IN ('error', 'click') AS bad,
          CASE WHEN r.event_type = 'view' THEN [] WHEN r.event_type IN ('error', 'click') THEN list_append(list_filter(s.fails, lambda x: r.t - x <= 100000), r.t) ELSE s.fails END AS f
        FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) x)
    SELECT user_id, event_id AS row_id, before AS old_state, state AS new_state FROM s WHERE state <> before""")
def link_states(spark, folder):
    kind = col_map("event_type", {"error": "failure", "click": "failure", "view": "success"}, "uploaded")
    e = readings(spark, folder).withColumn("event", kind)
    return stateful.run(e, ["user_id"], stateful.link_states("user_id", "bigint", window_s=100000.0)).drop("t")


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, value AS m FROM r WHERE rn = 1
      UNION ALL SELECT r.user_id, r.rn, r.event_id, 0.7 * s.m + 0.3 * r.value FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
    SELECT user_id, event_id AS row_id, round(m, 6) AS average FROM s""")
def ewma(spark, folder):
    out = stateful.run(readings(spark, folder), ["user_id"], stateful.exponential_average("user_id", "bigint", 0.3))
    return out.withColumn("average", F.round("average", 6))


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, 1.01 / 1.11 * value AS x, 1.01 * (1 - 1.01 / 1.11) AS p FROM r WHERE rn = 1
      UNION ALL SELECT r.user_id, r.rn, r.event_id, s.x + (s.p + 0.01) / (s.p + 0.11) * (r.value - s.x), (s.p + 0.01) * (1 - (s.p + 0.01) / (s.p + 0.11))
      FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
    SELECT user_id, event_id AS row_id, round(x, 6) AS filtered FROM s""")
def kalman(spark, folder):
    out = stateful.run(readings(spark, folder), ["user_id"], stateful.kalman_level("user_id", "bigint")).drop("t")
    return out.withColumn("filtered", F.round("filtered", 6))


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 0::DOUBLE AS pos, 0::DOUBLE AS vel, 1::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, 1::DOUBLE AS d FROM r
      UNION ALL SELECT user_id, rn, event_id, p + a / (a + 1) * (z - p), vel + c / (a + 1) * (z - p), a - a / (a + 1) * a, b - a / (a + 1) * b, c - c / (a + 1) * a, d - c / (a + 1) * b FROM (
        SELECT r.user_id, r.rn, r.event_id, r.value AS z, s.pos + s.vel * 0.1 AS p, s.vel, s.a + 0.1 * (s.b + s.c) + 0.01 * s.d + 0.01 AS a, s.b + 0.1 * s.d AS b, s.c + 0.1 * s.d AS c, s.d + 0.1 AS d
        FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) x)
    SELECT user_id, event_id AS row_id, round(pos, 6) AS position, round(vel, 6) AS velocity FROM s WHERE rn > 0""")
def kalman_motion(spark, folder):
    out = stateful.run(readings(spark, folder), ["user_id"], stateful.kalman_motion("user_id", "bigint"))
    return out.select("user_id", "row_id", F.round("position", 6).alias("position"), F.round("velocity", 6).alias("velocity"))


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, value AS m, CAST(0 AS DOUBLE) AS sd, CAST(0 AS DOUBLE) AS d, CAST(NULL AS VARCHAR) AS hit FROM r WHERE rn = 1
      UNION ALL SELECT user_id, rn, event_id, CASE WHEN h IS NULL THEN nm ELSE m END, CASE WHEN h IS NULL THEN 0.99 * sd + 0.01 * abs(value - nm) ELSE sd END,
          CASE WHEN h IS NULL THEN 0.99 * d + 0.01 * k ELSE d END, h FROM (
        SELECT r.user_id, r.rn, r.event_id, s.m, s.sd, s.d, r.value, r.k, 0.99 * s.m + 0.01 * r.value AS nm,
          CASE WHEN s.sd > 0 AND abs(r.value - s.m) / s.sd > 200 THEN 'z_score_violation' WHEN s.d > 0 AND r.k * 3 > s.d * 800 THEN 'rate_spike' WHEN r.k % 50 = 0 THEN 'flatline' END AS h
        FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) x)
    SELECT user_id, event_id AS row_id, hit AS anomaly_type FROM s WHERE hit IS NOT NULL""")
def adaptive_anomalies(spark, folder):
    e = ordered.ordered_scan(readings(spark, folder), ["user_id"], ["t", "row_id"], [ordered.row_number("_rn")]).select(
        "user_id", "row_id", "t", F.lit(100).alias("n"), F.col("value").alias("mean"), (F.col("k") * 3.0).alias("max_delta"),
        F.when((F.col("k") % 50 == 0) & (F.col("_rn") > 1), 0.0).otherwise(1.0).alias("spread"), F.col("k").cast("double").alias("recent_delta"),
    )
    machine = stateful.adaptive_anomalies("user_id", "bigint", z_limit=200.0, spike=800.0)
    return stateful.run(e, ["user_id"], machine).select("user_id", "row_id", "anomaly_type")


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT user_id, rn, event_id, CASE WHEN event_type IN ('error', 'click', 'view') THEN 1 ELSE 0 END AS c, FALSE AS fired FROM r WHERE rn = 1
      UNION ALL SELECT user_id, rn, event_id, CASE WHEN n >= 3 THEN 0 ELSE n END, n >= 3 FROM (
        SELECT r.user_id, r.rn, r.event_id, CASE WHEN r.event_type IN ('error', 'click', 'view') THEN s.c + 1 ELSE 0 END AS n FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) x)
    SELECT user_id, event_id AS row_id FROM s WHERE fired""")
def failure_counter(spark, folder):
    e = readings(spark, folder).withColumn("failed", F.col("event_type").isin("error", "click", "view"))
    return stateful.run(e, ["user_id"], stateful.failure_counter("user_id", "bigint")).select("user_id", "row_id")


# Each event is written, every seventh again; every third is acknowledged. Sensor times run behind by up to four steps.
_OPS = f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, row_id) AS rn FROM (
      SELECT user_id, event_id, us / 1e6 - (k % 5) * 20000 AS ts, unnest(CASE WHEN k % 7 = 0 THEN [0, 1] ELSE [0] END) AS n, 'write' AS kind, event_id * 3 + n AS row_id, us / 1e6 + n * 5000 AS t FROM {EVENTS_SQL} e
      UNION ALL SELECT user_id, event_id, us / 1e6 - (k % 5) * 20000, 2, 'ack', event_id * 3 + 2, us / 1e6 + 90000 FROM {EVENTS_SQL} e WHERE event_id % 3 = 0) x"""


@query(f"""
    WITH RECURSIVE r AS ({_OPS}), s AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS row_id, CAST([] AS STRUCT(ts DOUBLE, rn BIGINT, id BIGINT)[]) AS held, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS evicted FROM r
      UNION ALL SELECT user_id, rn, row_id,
        CASE WHEN kind = 'ack' THEN list_filter(held, lambda x: x.id <> event_id) WHEN there THEN rest ELSE list_sort(list_append(rest, {{'ts': ts, 'rn': rn, 'id': event_id}})) END,
        CASE WHEN kind = 'ack' THEN CASE WHEN there THEN 'acked' ELSE 'unknown' END WHEN there THEN 'ignored' ELSE 'stored' END, evicted FROM (
        SELECT *, len(list_filter(rest, lambda x: x.id = event_id)) > 0 AS there FROM (
          SELECT r.*, s.held, CASE WHEN r.kind = 'write' AND len(s.held) >= 4 THEN s.held[1].id END AS evicted, CASE WHEN r.kind = 'write' AND len(s.held) >= 4 THEN s.held[2:] ELSE s.held END AS rest
          FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) x) y)
    SELECT user_id, row_id, outcome, evicted, len(held) AS pending FROM s WHERE rn > 0""")
def buffer_with_acks(spark, folder):
    e = readings(spark, folder).select("user_id", F.col("row_id").alias("event_id"), (F.col("t") - F.col("k") % 5 * 20000).alias("ts"), "t", "k")
    again = F.when(F.col("k") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    writes = e.select("user_id", "event_id", "ts", "t", F.lit("write").alias("kind"), F.explode(again).alias("n"))
    acks = e.filter("event_id % 3 = 0").select("user_id", "event_id", "ts", "t", F.lit("ack").alias("kind"), F.lit(2).alias("n"))
    moved = F.col("t") + F.when(F.col("n") == 2, 90000).otherwise(F.col("n") * 5000)
    ops = writes.unionByName(acks).select("user_id", "event_id", "ts", "kind", moved.alias("t"), (F.col("event_id") * 3 + F.col("n")).alias("row_id"))
    return stateful.run(ops, ["user_id"], stateful.acknowledged_buffer("user_id", "bigint", "bigint", size=4)).drop("t", "event_id")


_METRES = """2 * 6371000 * atan2(sqrt(pow(sin(radians(r.lat - o.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(o.lat)) * pow(sin(radians(r.lon - o.lon) / 2), 2)),
          sqrt(1 - (pow(sin(radians(r.lat - o.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(o.lat)) * pow(sin(radians(r.lon - o.lon) / 2), 2))))"""


@query(f"""
    WITH RECURSIVE r AS (SELECT event_type, event_id, us / 1e6 / 200 AS t, 28.6::DOUBLE + (user_id % 12) * 0.0003::DOUBLE AS lat, 77.2::DOUBLE + (k % 5) * 0.0002::DOUBLE AS lon,
        row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS rn FROM {EVENTS_SQL} e),
    s AS (
      SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(t DOUBLE, id BIGINT, lat DOUBLE, lon DOUBLE)[]) AS open, CAST(NULL AS BIGINT) AS original FROM r
      UNION ALL SELECT event_type, rn, CASE WHEN len(near) > 0 THEN fresh ELSE list_append(fresh, {{'t': t, 'id': event_id, 'lat': lat, 'lon': lon}}) END, CASE WHEN len(near) > 0 THEN list_sort(near)[1].id ELSE event_id END FROM (
        SELECT r.*, list_filter(s.open, lambda o: r.t - o.t <= 600) AS fresh, list_filter(s.open, lambda o: r.t - o.t <= 600 AND {_METRES} <= 50) AS near
        FROM s JOIN r ON r.event_type = s.event_type AND r.rn = s.rn + 1) x)
    SELECT event_type, original, count(*) - 1 AS suppressed_count FROM s WHERE rn > 0 GROUP BY 1, 2""")
def suppress_alerts(spark, folder):
    """Defect alerts on a coarse grid of places, so that many fall within reach of each other."""
    e = readings(spark, folder).select(
        "event_type", "row_id", (F.col("t") / 200).alias("t"), (28.6 + (F.col("user_id") % 12) * 0.0003).alias("lat"), (77.2 + (F.col("k") % 5) * 0.0002).alias("lon")
    )
    kept = stateful.run(e, ["event_type"], stateful.suppression("event_type", "string"))
    return kept.groupBy("event_type", "original").agg((F.count(F.lit(1)) - 1).alias("suppressed_count"))


@query(f"""
    WITH RECURSIVE r AS {_R}, s AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(t DOUBLE, v DOUBLE, k DOUBLE)[]) AS buffer, CAST(0 AS BIGINT) AS filled, CAST(NULL AS DOUBLE) AS t, CAST([] AS STRUCT(t DOUBLE, v DOUBLE, k DOUBLE)[]) AS win, CAST(0 AS BIGINT) AS had FROM r
      UNION ALL SELECT user_id, rn, CASE WHEN len(grown) = 200 THEN [] ELSE grown END, CASE WHEN len(grown) = 200 THEN 0 ELSE total END, t, CASE WHEN len(grown) = 200 THEN grown ELSE [] END, total FROM (
        SELECT user_id, rn, t, CASE WHEN old THEN held ELSE list_concat(list_concat(held, fills), [{{'t': t, 'v': value, 'k': k}}])[-200:] END AS grown, filled + CASE WHEN old THEN 0 ELSE len(fills) END AS total FROM (
          SELECT *, coalesce(gap <= 0, FALSE) AS old, CASE WHEN gap > 3600 THEN list_transform(range(1, n + 1), lambda i: {{'t': last.t + i * (gap / (n + 1)), 'v': (1 - i / (n + 1)) * last.v + i / (n + 1) * value, 'k': (1 - i / (n + 1)) * last.k + i / (n + 1) * k}}) ELSE [] END AS fills FROM (
            SELECT *, least(CAST(round_even(gap, 0) AS BIGINT) - 1, 199) AS n FROM (
              SELECT r.user_id, r.rn, r.t, r.value, CAST(r.k AS DOUBLE) AS k, s.buffer AS held, s.filled, s.buffer[-1] AS last, r.t - s.buffer[-1].t AS gap
              FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) x) y) z) w)
    SELECT user_id, t, had / 200 * 100 AS interpolation_pct, round(list_avg(list_transform(win, lambda x: x.v)), 6) AS mean_value, round(list_avg(list_transform(win, lambda x: x.k)), 6) AS mean_k
    FROM s WHERE len(win) > 0""")
def asset_windows(spark, folder):
    """Asset windows with gap filling in the order of arrival, overflow included."""
    e = readings(spark, folder).select("user_id", "row_id", "t", "value", F.col("k").cast("double").alias("k"))
    out = stateful.run(e, ["user_id"], stateful.feature_windows("user_id", "bigint", ["value", "k"], size=200, longest_gap_s=3600.0))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value", "mean_k")})


@query(f"""
    WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM {EVENTS_SQL} e)
    SELECT user_id, event_id AS row_id, 30 AS rows FROM r WHERE rn >= 30 AND (rn - 30) % 10 = 0""")
def traffic_evidence(spark, folder):
    e = readings(spark, folder).withColumn("raw", F.concat(F.lit("m"), "row_id"))
    out = ordered.window_evidence(e, ["user_id"], ["t", "row_id"], ["row_id", "value", "raw"], 30, 10)
    return out.select("user_id", F.element_at("evidence", -1)["row_id"].alias("row_id"), F.size("evidence").alias("rows"))


def sample_windows(spark, folder, size: int = 32):
    numbered = ordered.tumbling_windows(readings(spark, folder), ["user_id"], ["t", "row_id"], size)
    return signal.stack_windows(numbered, ["user_id", "win"])


@query(f"""
    WITH r AS (SELECT user_id, (rn - 1) // 32 AS win, (rn - 1) % 32 AS pos, value, count(*) OVER (PARTITION BY user_id) AS n FROM {_R} x),
    x AS (SELECT * FROM r WHERE (win + 1) * 32 <= n),
    p AS (SELECT user_id, win, b.k, b.k * 125.0::DOUBLE AS f, power(sum(value * cos(2 * pi() * b.k * pos / 32)), 2) + power(sum(value * sin(2 * pi() * b.k * pos / 32)), 2) + 1e-12 AS w
      FROM x, (SELECT unnest(range(16)) AS k) b GROUP BY user_id, win, b.k)
    SELECT user_id, win, round(arg_max(f, w) FILTER (WHERE k > 0), 4) AS dominant_hz, round(10 * log10(max(w) FILTER (WHERE k > 0)), 4) AS dominant_db,
      round(sum(f * w) / sum(w), 4) AS centroid_hz, round(10 * log10(sum(w) FILTER (WHERE f <= 50) + 1e-12), 4) AS band_0_50_db,
      round(10 * log10(sum(w) FILTER (WHERE f BETWEEN 50 AND 200) + 1e-12), 4) AS band_50_200_db,
      round(10 * log10(sum(w) FILTER (WHERE f BETWEEN 200 AND 1000) + 1e-12), 4) AS band_200_1000_db,
      round(10 * log10(sum(w) FILTER (WHERE f BETWEEN 1000 AND 2000) + 1e-12), 4) AS band_1000_2000_db FROM p GROUP BY user_id, win""")
def spectrum(spark, folder):
    out = signal.spectral_features(sample_windows(spark, folder))
    return out.select("user_id", "win", *[F.round(c, 4).alias(c) for c in signal.SPECTRAL_FIELDS])


@query(f"""
    WITH r AS (SELECT user_id, (rn - 1) // 32 AS win, (rn - 1) % 32 AS pos, value, count(*) OVER (PARTITION BY user_id) AS n FROM {_R} x),
    x AS (SELECT * FROM r WHERE (win + 1) * 32 <= n),
    h AS (SELECT d, sum(sin(2 * pi() * k * d / 32)) / 16 AS h FROM (SELECT unnest(range(-31, 32)) AS d) a, (SELECT unnest(range(1, 16)) AS k) b GROUP BY d),
    e AS (SELECT x.user_id, x.win, x.pos, sqrt(any_value(x.value) * any_value(x.value) + power(sum(m.value * h.h), 2)) AS value
      FROM x JOIN x m ON m.user_id = x.user_id AND m.win = x.win JOIN h ON h.d = x.pos - m.pos GROUP BY x.user_id, x.win, x.pos),
    p AS (SELECT user_id, win, b.k, b.k * 125.0::DOUBLE AS f, power(sum(value * cos(2 * pi() * b.k * pos / 32)), 2) + power(sum(value * sin(2 * pi() * b.k * pos / 32)), 2) + 1e-12 AS w
      FROM e, (SELECT unnest(range(16)) AS k) b GROUP BY user_id, win, b.k)
    SELECT user_id, win, round(arg_max(f, w) FILTER (WHERE k > 0), 4) AS envelope_hz, round(10 * log10(max(w) FILTER (WHERE k > 0)), 4) AS envelope_db FROM p GROUP BY user_id, win""")
def envelope(spark, folder):
    out = signal.envelope_features(sample_windows(spark, folder))
    return out.select("user_id", "win", F.round("envelope_hz", 4).alias("envelope_hz"), F.round("envelope_db", 4).alias("envelope_db"))


_WAVE = f"""
    r AS (SELECT user_id, (rn - 1) // 32 AS win, (rn - 1) % 32 AS pos, value, rn, count(*) OVER (PARTITION BY user_id) AS n FROM {_R} x),
    l0 AS (SELECT user_id, win, pos, value AS a FROM r WHERE (win + 1) * 32 <= n),
    l1 AS (SELECT user_id, win, pos // 2 AS pos, sum(a) / sqrt(2) AS a, sum(CASE WHEN pos % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d FROM l0 GROUP BY user_id, win, pos // 2),
    l2 AS (SELECT user_id, win, pos // 2 AS pos, sum(a) / sqrt(2) AS a, sum(CASE WHEN pos % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d FROM l1 GROUP BY user_id, win, pos // 2)"""


@query(f"""
    WITH {_WAVE}
    SELECT user_id, win, round((SELECT avg(d * d) FROM l1 WHERE l1.user_id = w.user_id AND l1.win = w.win), 10) AS detail_1_energy,
      round((SELECT avg(d * d) FROM l2 WHERE l2.user_id = w.user_id AND l2.win = w.win), 10) AS detail_2_energy,
      round((SELECT avg(a * a) FROM l2 WHERE l2.user_id = w.user_id AND l2.win = w.win), 10) AS approx_energy FROM (SELECT DISTINCT user_id, win FROM l0) w""")
def wavelet(spark, folder):
    out = signal.wavelet_energy(sample_windows(spark, folder), levels=2)
    return out.select("user_id", "win", *[F.round(c, 10).alias(c) for c in ("detail_1_energy", "detail_2_energy", "approx_energy")])


@query(f"""
    WITH {_WAVE}, d AS (SELECT user_id, win, 1 AS level, pos, d FROM l1 UNION ALL SELECT user_id, win, 2, pos, d FROM l2),
    m AS (SELECT *, avg(abs(d)) OVER (PARTITION BY user_id, win, level) * 3 AS threshold FROM d)
    SELECT user_id, win, CAST(level AS INTEGER) AS level, CAST(pos AS INTEGER) AS position, round(abs(d), 6) AS magnitude FROM m WHERE abs(d) > threshold""")
def wavelet_transients(spark, folder):
    out = signal.wavelet_transients(sample_windows(spark, folder), factor=3.0, levels=2)
    return out.select("user_id", "win", "level", "position", F.round("magnitude", 6).alias("magnitude"))


@query()
def signal_pipeline(spark, folder):
    return signal.window_pipeline(readings(spark, folder).select("user_id", "row_id", "t", "value"), "user_id", "bigint", size=32, envelope=True)


@query()
def stopping_distance(spark, folder):
    e = events(spark, folder).select(
        F.col("event_id").alias("row_id"), col_map("event_type", {"click": "vande_bharat", "view": "wdp4d_mail"}, "other").alias("train_type"),
        (F.col("k") * 1.6).alias("speed_kmh"), (20 + F.col("user_id") / 100).alias("lat"), F.lit(77.0).alias("lon"),
        F.when(F.col("event_type") != "error", F.col("value") / 30).alias("vibration_rms"), (F.col("user_id") % 100).cast("double").alias("humidity_pct"),
    )
    n = F.col("n_nationkey")
    track = table(spark, folder, "nation").select(
        (20 + n / 100).alias("lat"), F.lit(77.0).alias("lon"), ((n - 12) / 1000.0).alias("gradient"), (n * 100.0).alias("curve_radius")
    )
    return braking.stopping_advisories(e, track)


@query()
def window_score(spark, folder):
    """Window features scored by the default classifier and by the reconstruction error."""
    from permaway.plans.aggregating import window_features

    windows = window_features(spark, folder)
    columns = ["mean", "std", "kurtosis", "zcr"]
    labelled = windows.withColumn("label", (F.col("crest_factor") > 2.5).cast("double"))
    scored = signal.logistic_scorer(labelled, columns, "label")(windows)
    both = signal.reconstruction_scorer(windows, columns)(scored)
    return both.select("user_id", "win", F.round("p", 4).alias("p"), F.round("mse", 4).alias("mse"))


@query()
def anomaly_evidence(spark, folder):
    """Sliding windows whose reconstruction error is over the limit, with their 60 raw messages."""
    e = readings(spark, folder).select("user_id", "row_id", "t", "value", F.concat(F.lit("m"), "row_id").alias("raw"))
    order, columns = ["t", "row_id"], ["mean", "std", "kurtosis", "zcr"]
    windows = ordered.sliding_windows(e, ["user_id"], order, 60, 10)
    features = durable(aggregates.window_statistics(windows, ["user_id", "win"], ["pos"], "value"))
    scored = signal.reconstruction_scorer(features, columns)(features)
    return signal.window_anomalies(scored, ordered.window_evidence(e, ["user_id"], order, ["row_id", "t", "raw"], 60, 10), ["user_id"])


_TOY = graph.Weights(
    {"runs_on": [[0.5, -0.2], [0.1, 0.3], [0.0, 0.4], [-0.3, 0.2], [0.2, 0.1]], "follows": [[-0.4, 0.6], [0.3, 0.0], [0.2, -0.5], [0.1, 0.1], [0.0, 0.7]]},
    [1.5, -2.0],
)


def _toy(kind: str, j: int, source: str) -> str:
    return "(" + " + ".join(f"{source}.f{i} * {_TOY.matrices[kind][i][j]}" for i in range(5)) + ")"


def _toy_message(j: int) -> str:
    return f"(e.w * CASE e.type WHEN 'runs_on' THEN {_toy('runs_on', j, 's')} ELSE {_toy('follows', j, 's')} END)"


@query(f"""
    WITH n AS (SELECT vec_id AS id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}' for i in range(5))} FROM embeddings),
    e AS (SELECT vec_id AS src, vec_id * vec_id % 50 AS dst, CASE WHEN vec_id % 2 = 0 THEN 'runs_on' ELSE 'follows' END AS type, 1 / (1 + CAST(label AS DOUBLE)) AS w FROM embeddings),
    m AS (SELECT e.dst, {_toy_message(0)} AS m0, {_toy_message(1)} AS m1 FROM e JOIN n s ON s.id = e.src),
    a AS (SELECT *, exp(1.5 * m0 - 2 * m1 - max(1.5 * m0 - 2 * m1) OVER (PARTITION BY dst)) AS x FROM m),
    g AS (SELECT dst, sum(x * m0) / (sum(x) + 1e-8) AS g0, sum(x * m1) / (sum(x) + 1e-8) AS g1 FROM a GROUP BY dst)
    SELECT id, round(tanh({_toy('runs_on', 0, 'n')} + coalesce(g0, 0)), 6) AS h0, round(tanh({_toy('runs_on', 1, 'n')} + coalesce(g1, 0)), 6) AS h1
    FROM n LEFT JOIN g ON g.dst = n.id""")
def message_round(spark, folder):
    v = table(spark, folder, "embeddings")
    nodes = v.select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("features"))
    edges = v.select(
        F.col("vec_id").alias("src"), (F.col("vec_id") * F.col("vec_id") % 50).alias("dst"),
        F.when(F.col("vec_id") % 2 == 0, "runs_on").otherwise("follows").alias("type"), (1 / (1 + F.col("label").cast("double"))).alias("weight"),
    )
    out = graph.message_round(nodes, edges, _TOY)
    return out.select("id", F.round(F.get("embedding", 0), 6).alias("h0"), F.round(F.get("embedding", 1), 6).alias("h1"))


def corridor_trains(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), (F.abs("c_acctbal") / 140).alias("km"), (F.col("c_custkey") % 160).cast("double").alias("speed"),
        (F.abs("c_acctbal") % 70).alias("delay"), (1 + F.col("c_nationkey") % 6).alias("priority"), F.when(F.col("c_custkey") % 2 == 0, "UP").otherwise("DN").alias("direction"),
    )


def live_graph(spark, folder):
    at = F.abs("s_acctbal") / 140
    defects = table(spark, folder, "supplier").select(at.alias("start_km"), (at + 1).alias("end_km"))
    return graph.corridor_graph(corridor_trains(spark, folder), corridor.stations(spark), corridor.segments(spark), defects)


@query()
def delay_forecast(spark, folder):
    nodes, edges = live_graph(spark, folder)
    return graph.predict_delays(nodes, edges, graph.seeded_weights())


@query("""
    WITH t AS (SELECT c_custkey, abs(c_acctbal) / 140 AS km FROM customer)
    SELECT 'train' AS type, count(*) AS nodes FROM t UNION ALL SELECT 'station', 6 UNION ALL SELECT 'segment', 5""")
def graph_nodes(spark, folder):
    from permaway.operators.aggregates import node_counts

    nodes, _ = live_graph(spark, folder)
    return node_counts(nodes)


@query("""
    WITH t AS (SELECT abs(c_acctbal) / 140 AS km FROM customer)
    SELECT CASE WHEN km <= 14 THEN 'seg-ndls-anvt' WHEN km <= 27 THEN 'seg-anvt-gzb' WHEN km <= 43 THEN 'seg-gzb-murn' WHEN km <= 54 THEN 'seg-murn-modi' ELSE 'seg-modi-mert' END AS segment,
      count(*) AS occupancy FROM t WHERE km <= 72 GROUP BY 1""")
def segment_occupancy(spark, folder):
    from permaway.operators.aggregates import occupancy

    _, edges = live_graph(spark, folder)
    return occupancy(edges)


@query("""
    SELECT c_custkey, round(6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM (
      SELECT c_custkey, power(sin(radians(n_nationkey / 50.0 - c_acctbal / 5000) / 2), 2) + cos(radians(28 + c_acctbal / 5000)) * cos(radians(28 + n_nationkey / 50.0)) * power(sin(radians(0.25) / 2), 2) AS a
      FROM customer JOIN nation ON c_nationkey = n_nationkey) x""")
def distances(spark, folder):
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    d = scalars.haversine_m(28 + F.col("c_acctbal") / 5000, F.lit(77.0), 28 + F.col("n_nationkey") / 50.0, F.lit(77.25))
    return j.select("c_custkey", F.round(d, 3).alias("metres"))


_UNIFORM = "(CAST('0x' || substr(md5(concat_ws('|', vec_id, pos, 7, {})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


@query(f"""
    WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings)
    SELECT vec_id, pos, round(x + {federated.NOISE_SIGMA}::DOUBLE * (sqrt(-2.0::DOUBLE * ln({_UNIFORM.format(1)})) * cos(2.0::DOUBLE * pi() * ({_UNIFORM.format(2)}))), 6) AS x FROM v""")
def private_noise(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("gradients"))
    out = federated.private_noise(v, "vec_id")
    return out.select("vec_id", F.posexplode("gradients").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


@query("""
    WITH r AS (SELECT DISTINCT epoch_us(o_orderdate) AS d FROM orders), n AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM r)
    SELECT d AS round_no, i - 1 < 50 AS noised, CAST(greatest(0, 50 - i) AS DOUBLE) AS remaining FROM n""")
def privacy_budget(spark, folder):
    rounds = table(spark, folder, "orders").select(F.unix_micros("o_orderdate").alias("round_no")).distinct()
    return federated.budget_left(rounds)


@query(f"SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) % 10000 < 9000 THEN 'stable' ELSE 'candidate' END AS version FROM {EVENTS_SQL} e")
def canary_split(spark, folder):
    version = signal.canary_version(F.col("event_id"), {"stable": 90.0, "candidate": 10.0})
    return events(spark, folder).select("event_id", version.alias("version"))


@query("""
    SELECT d.doc_id, d.lang AS class, CASE d.lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END || ' 0.500000 0.500000 0.500000 0.400000' || chr(10) AS label
    FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def default_labels(spark, folder):
    images = table(spark, folder, "documents").select(F.col("lang").alias("class"), F.col("doc_id").alias("stem"))
    labelled = table(spark, folder, "labels").join(images, F.col("doc_id") == F.col("stem")).select("class", "stem")
    index = F.when(F.col("class") == "en", 0).when(F.col("class") == "fr", 1).otherwise(2)
    return signal.missing_labels(images, labelled, index).withColumnRenamed("stem", "doc_id")
