"""Queries on feeds, validation, archives and row rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from permaway.functions import risk
from permaway.operators import rules, validate
from permaway.plans.registry import EVENTS_SQL, col_map, events, query, sql_map, table
from permaway.sources import archive, corridor, feeds, series

SENSORS = {"click": "vibration", "purchase": "temperature", "signup": "gps", "view": "acoustic"}
SENSOR_SQL = sql_map("event_type", SENSORS, "broken")
LOGS = {
    "error": "monitoring.alerts", "purchase": "audit.inference", "signup": "security.anomalies",
    "click": "dead-letter.schema-failures",
}


def messages(spark, folder):
    """Events as raw JSON texts with flaws that depend on ``k``: 99 is cut short, 98 lacks the asset."""
    e = events(spark, folder)
    asset = F.when(F.col("k") == 98, F.lit("")).otherwise(F.format_string('"assetId":"a-%d",', "user_id"))
    extra = F.when(F.col("k") % 7 == 0, F.lit(',"zone":"z1"')).otherwise(F.lit(""))
    payload = F.when(F.col("k") % 5 == 0, F.lit("{}")).otherwise(
        F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"unit":"g","fresh":true,"none":null}'))
    )
    text = F.concat(
        F.format_string('{"eventId":"e-%d","sourceId":"s-%d","sensorType":"', "event_id", "user_id"),
        col_map("event_type", SENSORS, "broken"), F.lit('",'), asset,
        F.format_string('"timestamp_utc":"%s","sequence":%d,"payload":', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("k") - 5),
        payload, F.lit(',"quality_flags":{"interpolated":false,"interpolation_pct":'), F.col("value").cast("string"),
        F.lit(',"clock_reliable":true,"drift_ms":5.0},"schema_version":"1.0.0"'), extra, F.lit("}"),
    )
    cut = F.when(F.col("k") == 99, F.expr("substring(value_text, 1, length(value_text) - 1)")).otherwise(F.col("value_text"))
    return e.withColumn("value_text", text).select(
        "event_id", F.concat(F.lit("track."), "event_type").alias("topic"), cut.alias("value"), "ts", "us"
    )


_LENIENT = f"""
    SELECT event_id, us, 'track.' || event_type AS topic, {SENSOR_SQL} AS sensor, k,
      CASE WHEN k = 99 THEN '(root):not JSON' ELSE concat_ws(';',
        CASE WHEN k = 98 THEN '(root):missing assetId' END,
        CASE WHEN value > 100 THEN 'quality_flags/interpolation_pct:above maximum' END,
        CASE WHEN event_type = 'error' THEN 'sensorType:not in enum' END,
        CASE WHEN k < 5 THEN 'sequence:below minimum' END) END AS errors
    FROM {EVENTS_SQL} e"""


def _error_text():
    return F.concat_ws(";", F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["message"])))


@query(f"SELECT event_id, errors = '' AS ok, errors FROM ({_LENIENT}) v")
def validate_events(spark, folder):
    return validate.validate_events(messages(spark, folder)).select("event_id", "ok", _error_text().alias("errors"))


@query(f"""
    SELECT event_id, CASE WHEN k = 99 THEN '(root):not JSON' ELSE concat_ws(';',
        CASE WHEN k = 98 THEN '(root):missing assetId' END,
        CASE WHEN k % 7 = 0 THEN '(root):unknown key' END,
        CASE WHEN k % 5 = 0 THEN 'payload:empty' END,
        CASE WHEN value > 100 THEN 'quality_flags/interpolation_pct:above maximum' END,
        CASE WHEN event_type = 'error' THEN 'sensorType:not in enum' END,
        CASE WHEN k < 5 THEN 'sequence:below minimum' END) END AS errors
    FROM {EVENTS_SQL} e""")
def validate_strict(spark, folder):
    return validate.validate_events(messages(spark, folder), "strict").select("event_id", _error_text().alias("errors"))


@query(f"""
    SELECT target, kind, us FROM (
      SELECT topic || '_validated' AS target, 'valid' AS kind, us FROM ({_LENIENT}) v WHERE errors = ''
      UNION ALL SELECT 'dead-letter.schema-failures', 'dead_letter', us FROM ({_LENIENT}) v WHERE errors <> ''
      UNION ALL SELECT 'monitoring.alerts', 'alert', us FROM ({_LENIENT}) v WHERE errors <> '') u""")
def fanout_dead_letter(spark, folder):
    out = validate.fan_out(validate.validate_events(messages(spark, folder)))
    return out.select("target", "kind", F.unix_micros("ts").alias("us"))


@query(f"""
    SELECT topic AS source_feed, count(*) AS alerts, CAST(sum(len(string_split(errors, ';'))) AS BIGINT) AS errors
    FROM ({_LENIENT}) v WHERE errors <> '' GROUP BY topic""")
def feed_alerts(spark, folder):
    alerts = validate.feed_alert(validate.validate_events(messages(spark, folder)))
    return alerts.groupBy("source_feed").agg(F.count(F.lit(1)).alias("alerts"), F.sum("error_count").alias("errors"))


@query(f"""
    SELECT event_id, CASE WHEN k = 99 THEN 'dead-letter.schema-failures' ELSE CASE sensor
        WHEN 'vibration' THEN 'track.sensor.vibration' WHEN 'temperature' THEN 'track.sensor.temperature'
        WHEN 'acoustic' THEN 'track.sensor.acoustic' WHEN 'gps' THEN 'train.telemetry.position'
        ELSE 'train.telemetry.omrs' END END AS target FROM ({_LENIENT}) v""")
def route_topics(spark, folder):
    return validate.route_valid(messages(spark, folder)).select("event_id", "target")


@query(f"""
    WITH p AS (SELECT {SENSOR_SQL} AS measurement, CASE WHEN k = 98 THEN 'unknown' ELSE 'a-' || user_id END AS asset,
        'track.' || event_type AS topic, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, value, k
      FROM {EVENTS_SQL} e WHERE k <> 99 AND k % 5 <> 0)
    SELECT measurement, asset, topic, time, 'value' AS field, value FROM p
    UNION ALL SELECT measurement, asset, topic, time, 'fresh', CAST(1.0 AS DOUBLE) FROM p""")
def point_projection(spark, folder):
    points = series.to_points(messages(spark, folder))
    return series.points_long(points).select(
        "measurement", F.col("tags")["asset_id"].alias("asset"), F.col("tags")["topic"].alias("topic"), "time", "field", "value"
    )


@query(f"""
    WITH l AS (SELECT {sql_map('event_type', LOGS, 'other.topic')} AS topic, k,
        CASE WHEN k % 2 = 0 AND k % 9 <> 0 THEN date_trunc('second', ts) + INTERVAL 1 DAY ELSE ts END AS moment FROM {EVENTS_SQL} e)
    SELECT topic || '-' || strftime(moment, '%Y.%m.%d') AS "index",
      CASE WHEN topic LIKE 'monitoring.alerts%' THEN 'system_alert' WHEN topic LIKE 'audit.%' THEN 'audit'
        WHEN topic LIKE 'security.%' THEN 'security' WHEN topic LIKE 'dead-letter.%' THEN 'dead_letter' END AS tag,
      count(*) AS n, count(*) FILTER (WHERE k % 9 <> 0) AS parsed FROM l GROUP BY 1, 2""")
def log_index_daily(spark, folder):
    e = events(spark, folder)
    later = F.date_format(F.col("ts") + F.make_interval(days=F.lit(1)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(F.col("k") % 9 == 0, F.lit("no json")).when(
        F.col("k") % 2 == 0, F.concat(F.lit('{"timestamp_utc":"'), later, F.lit('"}'))
    ).otherwise(F.lit("{}"))
    rows = series.log_rows(e.select(col_map("event_type", LOGS, "other.topic").alias("topic"), body.alias("value"), "ts"))
    return rows.groupBy("index", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("parsed").alias("parsed"))


@query("""
    SELECT count(*) AS points FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2880 MINUTE AND ts < TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'click'""")
def recent_points(spark, folder):
    e = events(spark, folder).withColumnRenamed("event_type", "measurement")
    return series.recent_count(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), "click", minutes=2880)


@query("""
    SELECT p_partkey, substr(sha256('data/' || p_brand || '/' || p_type || '::' || '["' || replace(p_name, ' ', '", "') || '"]'), 1, 32)
        AS dataset_version_id, substr(sha256('["' || replace(p_name, ' ', '", "') || '"]'), 1, 16) AS preprocessing_hash,
        p_type AS dataset_name FROM part""")
def dataset_version(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.concat_ws("/", F.lit("data"), "p_brand", "p_type").alias("path"), F.split("p_name", " ").alias("steps")
    )
    return archive.register_datasets(p).select("p_partkey", "dataset_version_id", "preprocessing_hash", "dataset_name")


@query("SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL 365 DAY) AS retain_us FROM orders")
def retained_audit(spark, folder):
    kept = archive.with_retention(table(spark, folder, "orders"), "o_orderdate")
    return kept.select("o_orderkey", F.unix_micros("retain_until").alias("retain_us"))


@query("""
    SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey) AS r FROM customer) c
    WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey)""")
def insert_or_ignore(spark, folder):
    new = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    old = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"))
    return archive.insert_or_ignore(old, new.union(new), ["id"]).withColumnRenamed("id", "c_custkey")


@query(f"""
    SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS rms, CAST(k AS DOUBLE) AS speed, CAST(0.0 AS DOUBLE) AS load_left
    FROM {EVENTS_SQL} e""")
def feature_vectors(spark, folder):
    e = events(spark, folder)
    payload = F.create_map(
        F.lit("bearing_rms_g"), F.col("value").cast("string"), F.lit("speed_kmh"), F.col("k").cast("string"),
        F.lit("wheel_load_left_kn"), F.lit("7"),
    )
    v = rules.feature_vector(payload, rules.BOGIE_KEYS)
    at = lambda i: F.get(v, i).cast("double")
    return e.select("event_id", at(0).alias("rms"), at(7).alias("speed"), at(4).alias("load_left"))


@query(f"""
    SELECT event_id, round(s, 6) AS score, CASE WHEN s >= 3.2 THEN 1 WHEN s >= 2.0 THEN 2 ELSE 3 END AS tier FROM (
      SELECT event_id, least(value / 60 * CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END, 4.0) AS s
      FROM events) x""")
def risk_tiers(spark, folder):
    severity = col_map("event_type", {"error": "Critical", "click": "high", "purchase": "MEDIUM", "signup": "LOW"}, "odd")
    score = risk.risk_score(F.col("value") / 60, risk.severity_weight(severity))
    return events(spark, folder).select("event_id", F.round(score, 6).alias("score"), risk.risk_tier(score).alias("tier"))


@query(f"""
    WITH b AS (SELECT event_id, k AS pct, least(1.0, value / 50) AS p FROM {EVENTS_SQL} e),
    i AS (SELECT *, greatest(0, p - 0.15) AS lo0, least(1, p + 0.15) AS hi0 FROM b),
    w AS (SELECT *, CASE WHEN pct > 0 THEN greatest(0, 0.3 * (1 + pct / 20.0) + 0.0002 - (hi0 - lo0)) / 2 ELSE 0 END AS ext FROM i)
    SELECT event_id, CASE WHEN pct > 40 THEN 'INSUFFICIENT_DATA' ELSE 'MAINTENANCE_ADVISORY' END AS alert_type,
      CASE WHEN pct <= 40 THEN round(p, 4) END AS failure_probability,
      CASE WHEN pct <= 40 THEN round(greatest(0, lo0 - ext), 4) END AS ci_lower,
      CASE WHEN pct <= 40 THEN round(least(1, hi0 + ext), 4) END AS ci_upper,
      CASE WHEN pct <= 40 THEN round(least(p * 3, 4), 4) END AS risk_score,
      CASE WHEN pct <= 40 THEN CASE WHEN p * 3 >= 3.2 THEN 1 WHEN p * 3 >= 2 THEN 2 ELSE 3 END END AS risk_tier
    FROM w WHERE pct > 40 OR p > 0.8""")
def advisory_split(spark, folder):
    e = events(spark, folder).select("event_id", F.col("k").alias("interpolation_pct"), (F.col("value") / 50).alias("p"))
    return rules.advisory_split(e, base_width=0.3).select(
        "event_id", "alert_type", "failure_probability", "ci_lower", "ci_upper", "risk_score", "risk_tier"
    )


@query(f"""
    SELECT event_id, CASE WHEN value / 20 > 4 THEN 'HIGH' ELSE 'NORMAL' END AS priority,
      CASE WHEN value / 20 > 4 THEN 100 ELSE 500 END AS deadline_ms
    FROM {EVENTS_SQL} e WHERE value / 20 > 2 OR abs((k - 50) / 10.0) > 4""")
def inference_trigger(spark, folder):
    e = events(spark, folder).select("event_id", (F.col("value") / 20).alias("rms"), ((F.col("k") - 50) / 10).alias("kurtosis"))
    return rules.inference_requests(e).select("event_id", "priority", "deadline_ms")


@query(f"""
    SELECT event_id, CASE WHEN k * 10 > 500 THEN 'deadline_miss' WHEN event_type = 'error' AND user_id % 4 > 1 THEN 'throttled'
      ELSE 'accepted' END AS status FROM {EVENTS_SQL} e""")
def admission_states(spark, folder):
    status = rules.admission_status(F.col("k") * 10, F.lit(500), F.col("user_id") % 4, F.col("event_type") == "error")
    return events(spark, folder).select("event_id", status.alias("status"))


@query(f"""
    SELECT event_id, round((k + least(value, 100) * 2 + user_id % 100) / 400.0, 6) AS utilization,
      (event_type <> 'error' AND user_id % 5 < 4 AND least(value, 100) < 95 AND k < 85) AS can_accept FROM {EVENTS_SQL} e""")
def node_capacity(spark, folder):
    gpu = F.least(F.col("value"), F.lit(100.0))
    return events(spark, folder).select(
        "event_id", F.round(rules.utilization(F.col("k"), gpu, F.col("user_id") % 100), 6).alias("utilization"),
        rules.can_accept(F.col("event_type") != "error", F.col("user_id") % 5, F.lit(4), gpu, F.col("k")).alias("can_accept"),
    )


_STATIONS = """(SELECT s_suppkey AS station, CAST(s_suppkey * 37 % 1500 AS BIGINT) AS queue_depth,
    50 + abs(s_acctbal) / 150 AS temperature_c, CASE WHEN s_nationkey % 4 = 0 THEN 'OVERLOADED' ELSE 'HEALTHY' END AS health FROM supplier)"""


@query(f"""
    SELECT station, 'queue_depth' AS metric, '1000' AS threshold FROM {_STATIONS} s WHERE queue_depth > 1000
    UNION ALL SELECT station, 'temperature', '85.0' FROM {_STATIONS} s WHERE temperature_c > 85
    UNION ALL SELECT station, 'health', 'HEALTHY' FROM {_STATIONS} s WHERE health = 'OVERLOADED'""")
def sla_rows(spark, folder):
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 37 % 1500).alias("queue_depth"),
        (50 + F.abs("s_acctbal") / 150).alias("temperature_c"),
        F.when(F.col("s_nationkey") % 4 == 0, "OVERLOADED").otherwise("HEALTHY").alias("health"),
    )
    return rules.sla_violations(s).select("station", "metric", "threshold")


@query(f"""
    SELECT event_id, CASE WHEN k % 3 = 0 THEN 'c' || k WHEN k % 3 = 1 THEN 't' || k ELSE 'unknown' END AS container_name,
      CASE WHEN k % 3 = 1 THEN 'p' || user_id ELSE 'unknown' END AS pod_name
    FROM {EVENTS_SQL} e WHERE event_type = 'error' OR event_type = 'click'""")
def privilege_alerts(spark, folder):
    e = events(spark, folder)
    shaped = e.select(
        "event_id", F.when(F.col("event_type") == "error", "x Privilege_Escalation y").otherwise("other").alias("rule"),
        F.when(F.col("event_type") == "click", "critical").otherwise("warning").alias("priority"),
        F.when(F.col("k") % 3 == 1, F.format_string("a container=t%d pod=p%d end", "k", "user_id")).otherwise("none").alias("output"),
        F.create_map(F.lit("container.name"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), "k")).otherwise("")).alias("output_fields"),
    )
    return rules.privilege_alerts(shaped).select("event_id", "container_name", "pod_name")


_SYSCALLS = f"""(SELECT event_id, CASE event_type WHEN 'error' THEN 'setuid' WHEN 'click' THEN 'capset' ELSE 'read' END AS syscall,
    CASE WHEN k % 10 = 0 THEN 'host' WHEN k % 10 = 1 THEN 'delay-predictor' ELSE 'web' END AS container,
    CASE WHEN k % 4 = 0 THEN 'runc' ELSE 'sh' END AS proc, CASE WHEN user_id % 6 = 0 THEN 'default' ELSE 'corridor' END AS namespace,
    CASE WHEN event_type = 'view' THEN 'mkdir' WHEN event_type = 'signup' THEN 'connect' ELSE 'stat' END AS operation,
    CASE WHEN user_id % 2 = 0 THEN '/etc/x' ELSE '/home/x' END AS path, CASE WHEN user_id % 3 = 0 THEN 'mlflow' ELSE '10.0.0.1' END AS remote
    FROM {EVENTS_SQL} e)"""


@query(f"""
    SELECT event_id, 'privilege_escalation' AS rule, 'CRITICAL' AS rule_priority FROM {_SYSCALLS} s
      WHERE syscall = 'setuid' AND container <> 'host' AND proc <> 'runc' AND namespace = 'corridor'
    UNION ALL SELECT event_id, 'capability_addition', 'CRITICAL' FROM {_SYSCALLS} s
      WHERE syscall = 'capset' AND container <> 'host' AND proc <> 'runc' AND namespace = 'corridor'
    UNION ALL SELECT event_id, 'read_only_filesystem', 'WARNING' FROM {_SYSCALLS} s
      WHERE operation = 'mkdir' AND path LIKE '/etc%' AND container <> 'host' AND proc <> 'runc' AND namespace = 'corridor'
    UNION ALL SELECT event_id, 'outbound_connection', 'WARNING' FROM {_SYSCALLS} s
      WHERE operation = 'connect' AND namespace = 'corridor' AND container = 'delay-predictor' AND remote <> 'mlflow'""")
def runtime_rules(spark, folder):
    pick = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    shaped = events(spark, folder).select(
        "event_id", col_map("event_type", {"error": "setuid", "click": "capset"}, "read").alias("syscall"),
        F.when(F.col("k") % 10 == 0, "host").when(F.col("k") % 10 == 1, "delay-predictor").otherwise("web").alias("container"),
        pick(F.col("k") % 4 == 0, "runc", "sh").alias("proc"), pick(F.col("user_id") % 6 == 0, "default", "corridor").alias("namespace"),
        col_map("event_type", {"view": "mkdir", "signup": "connect"}, "stat").alias("operation"),
        pick(F.col("user_id") % 2 == 0, "/etc/x", "/home/x").alias("path"), pick(F.col("user_id") % 3 == 0, "mlflow", "10.0.0.1").alias("remote"),
    )
    return rules.match_runtime_rules(shaped, "corridor").select("event_id", "rule", "rule_priority")


@query("""
    WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Rajdhani' WHEN 'FURNITURE' THEN 'Vande-Bharat'
        WHEN 'BUILDING' THEN 'Freight' ELSE 'Express' END AS train_class FROM customer)
    SELECT c_custkey, train_class, CAST(CASE train_class WHEN 'Rajdhani' THEN 1 WHEN 'Vande-Bharat' THEN 1 WHEN 'Freight' THEN 6 ELSE 4 END AS INTEGER) AS priority,
      CAST(CASE train_class WHEN 'Rajdhani' THEN 130 WHEN 'Vande-Bharat' THEN 160 WHEN 'Freight' THEN 60 ELSE 100 END AS INTEGER) AS speed FROM c""")
def train_classes(spark, folder):
    name = col_map("c_mktsegment", {"MACHINERY": "RAJDHANI-1", "FURNITURE": "x-vande-bharat", "BUILDING": "freight 7"}, "no class")
    cls = corridor.train_class(name)
    return table(spark, folder, "customer").select(
        "c_custkey", cls.alias("train_class"), corridor.class_priority(cls).alias("priority"), corridor.class_speed(cls).alias("speed")
    )


@query("""
    SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_retailprice - c) / p_retailprice, 6) AS degradation,
      round(abs(c - p_retailprice) / p_retailprice * 100, 2) AS degradation_pct,
      CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_retailprice - c) / p_retailprice <= 0.05 AS passed
    FROM (SELECT *, p_retailprice * (0.85 + p_size / 170.0) AS c FROM part) p""")
def regression_gate(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.col("p_retailprice").alias("deployed"), (F.col("p_retailprice") * (0.85 + F.col("p_size") / 170.0)).alias("candidate"),
        F.when(F.col("p_size") % 2 == 0, "lower").otherwise("higher").alias("direction"),
    )
    out = rules.regression_gate(p, direction="direction")
    return out.select("p_partkey", F.round("degradation", 6).alias("degradation"), "degradation_pct", "passed")


@query(f"""
    SELECT event_id, CASE WHEN k % 3 = 0 THEN 0.0 ELSE value END AS current_delay_min,
      CASE WHEN k % 4 = 0 THEN 0.5 ELSE k / 100.0 END AS load_factor, CAST(1.0 AS DOUBLE) AS schedule_adherence FROM {EVENTS_SQL} e""")
def snapshot_defaults(spark, folder):
    e = events(spark, folder).select(
        "event_id", F.when(F.col("k") % 3 != 0, F.col("value")).alias("current_delay_min"),
        F.when(F.col("k") % 4 != 0, F.col("k") / 100.0).alias("load_factor"), F.lit(None).cast("double").alias("schedule_adherence"),
    )
    return rules.snapshot_defaults(e)


@query(f"SELECT event_id, (event_type <> 'error' AND k >= 5 AND value <= 100) AS good FROM {EVENTS_SQL} e")
def reading_quality(spark, folder):
    good = rules.reading_quality(col_map("event_type", SENSORS, "broken"), F.col("k") - 5, F.col("value"))
    return events(spark, folder).select("event_id", good.alias("good"))


@query(f"""
    SELECT user_id AS node_id, round(least(100.0, count(*) FILTER (WHERE k % 2 <> 0) / 40.0 * 100), 6) AS capacity_pct,
      least(100.0, count(*) FILTER (WHERE k % 2 <> 0) / 40.0 * 100) >= 90 AS over FROM {EVENTS_SQL} e GROUP BY user_id""")
def buffer_fill(spark, folder):
    e = events(spark, folder).select(F.col("user_id").alias("node_id"), (F.col("k") % 2 == 0).alias("acked"))
    return rules.buffer_capacity(e, max_rows=40).withColumn("capacity_pct", F.round("capacity_pct", 6))


@query(f"""
    SELECT user_id, epoch_us(date_trunc('day', ts)) AS day_us, round(max(value) FILTER (WHERE event_type = 'error') /
        max(value) FILTER (WHERE event_type = 'click'), 6) AS ratio FROM events GROUP BY user_id, date_trunc('day', ts)
    HAVING max(value) FILTER (WHERE event_type = 'error') / max(value) FILTER (WHERE event_type = 'click') > 1.5""")
def gauge_ratio(spark, folder):
    e = events(spark, folder).select(
        F.col("event_type").alias("metric"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.date_trunc("day", "ts").alias("ts"), "value",
    )
    out = rules.ratio_alerts(e, "error", "click", 1.5)
    return out.select(
        F.get_json_object("labels", "$.user").cast("bigint").alias("user_id"), F.unix_micros("ts").alias("day_us"), F.round("ratio", 6).alias("ratio")
    )


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 120")
def gauge_alerts(spark, folder):
    e = events(spark, folder).withColumnRenamed("event_type", "metric")
    return rules.gauge_alerts(e, "error", 120.0).select("event_id", "value")


@query("""SELECT event_id, CASE WHEN value * 40 > 5000 THEN 'OVERLOADED' WHEN value * 40 > 1000 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
    value / 100 > 0.8 AS escalated FROM events""")
def node_health(spark, folder):
    e = events(spark, folder).withColumn("confidence", F.col("value") / 100)
    raised = rules.defect_alerts(e).select("event_id", F.lit(True).alias("escalated"))
    return e.select("event_id", rules.node_health(F.col("value") * 40).alias("health")).join(raised, "event_id", "left").select(
        "event_id", "health", F.coalesce("escalated", F.lit(False)).alias("escalated")
    )


_REQUESTS = """(SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Engineering_Team' ELSE 'Security_Officer' END AS role,
    CASE event_type WHEN 'click' THEN 'GET' ELSE 'post' END AS method,
    CASE user_id % 5 WHEN 0 THEN '/api/v1/models/m1/rollback' WHEN 1 THEN '/api/v2/audit/x' WHEN 2 THEN '/api/v1/retention/holds/3'
      WHEN 3 THEN '/api/v1/digital-twin' ELSE '/nowhere' END AS path, user_id % 5 AS p FROM events)"""


@query(f"""
    SELECT event_id, CASE p WHEN 0 THEN method = 'post' AND role = 'Engineering_Team' WHEN 1 THEN method = 'GET'
        WHEN 2 THEN FALSE WHEN 3 THEN method = 'GET' AND role = 'Engineering_Team' ELSE FALSE END AS permitted FROM {_REQUESTS} r""")
def rule_match(spark, folder):
    paths = ["/api/v1/models/m1/rollback", "/api/v2/audit/x", "/api/v1/retention/holds/3", "/api/v1/digital-twin", "/nowhere"]
    e = events(spark, folder).select(
        "event_id", F.array(F.when(F.col("user_id") % 2 == 0, "Engineering_Team").otherwise("Security_Officer")).alias("roles"),
        F.when(F.col("event_type") == "click", "GET").otherwise("post").alias("method"),
        F.get(F.array(*[F.lit(p) for p in paths]), F.col("user_id").cast("int") % 5).alias("path"),
    )
    return rules.access_decision(e).select("event_id", "permitted")


@query(f"""
    SELECT event_id, CASE WHEN k % 10 = 0 OR k % 10 = 1 THEN 0.0 ELSE value END AS packet_rate,
      CASE WHEN k % 10 = 0 OR k % 10 = 1 OR k % 10 = 2 THEN CAST(0.0 AS DOUBLE) ELSE CAST(k AS DOUBLE) END AS payload_size FROM {EVENTS_SQL} e""")
def traffic_features(spark, folder):
    e = events(spark, folder)
    raw = (
        F.when(F.col("k") % 10 == 0, F.lit("{broken"))
        .when(F.col("k") % 10 == 1, F.concat(F.lit('{"packet_rate":'), F.col("value").cast("string"), F.lit(',"payload_size":"many"}')))
        .when(F.col("k") % 10 == 2, F.concat(F.lit('{"packet_rate":'), F.col("value").cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"packet_rate":'), F.col("value").cast("string"), F.lit(',"payload_size":'), F.col("k").cast("string"), F.lit("}")))
    )
    out = feeds.traffic_features(e.select("event_id", raw.alias("raw")))
    return out.select("event_id", F.get("features", 0).alias("packet_rate"), F.get("features", 3).alias("payload_size"))


@query(f"""
    SELECT 'ntes-' || user_id AS source_id, 'loco-' || user_id AS asset_id, k AS sequence, value AS latitude,
      CASE WHEN k % 2 = 0 THEN 'S' || k ELSE 'UNKNOWN' END AS station FROM {EVENTS_SQL} e WHERE k % 11 <> 0 AND k % 13 <> 0""")
def position_feed(spark, folder):
    e = events(spark, folder)
    station = F.when(F.col("k") % 2 == 0, F.format_string(',"station_code":"S%d"', "k")).otherwise("")
    lon = F.when(F.col("k") % 13 == 0, F.lit("")).otherwise(F.lit('"longitude":77.2,'))
    record = F.concat(
        F.format_string('{"train_number":"%d",', "user_id"), lon, F.lit('"latitude":'), F.col("value").cast("string"),
        F.format_string(',"sequence_no":%d', "k"), station, F.lit("}"),
    )
    text = F.when(F.col("k") % 11 == 0, record).otherwise(F.concat(F.lit("["), record, F.lit("]")))
    parsed, _ = feeds.parse_positions(e.select(text.alias("value")), ingest_ts=F.lit("2024-01-01").cast("timestamp"))
    return parsed.select(
        F.col("sourceId").alias("source_id"), F.col("assetId").alias("asset_id"), "sequence",
        F.col("payload")["latitude"].cast("double").alias("latitude"), F.col("payload")["station_code"].alias("station"),
    )


@query(f"""
    SELECT 'omrs-' || user_id AS source_id, 'loco-' || user_id % 10 AS asset_id, k AS sequence, value AS vibration_rms
    FROM {EVENTS_SQL} e, range(2) WHERE k % 11 <> 0""")
def bogie_frames(spark, folder):
    e = events(spark, folder)
    numbers = F.lit("".join(f',"{n}":1.5' for n in feeds.BOGIE_NUMBERS[1:-1]))
    speed = F.when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.lit(',"speed_kmh":90.0'))
    text = F.concat(
        F.format_string('{"sensor_id":"%d","train_id":"%d","sequence_no":%d,"vibration_rms":', "user_id", F.col("user_id") % 10, "k"),
        F.col("value").cast("string"), numbers, speed, F.lit("}"),
    )
    body = F.encode(text, "UTF-8")
    frame = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), body)
    blobs = e.select(F.concat(frame, frame).alias("content"), F.col("event_id").cast("string").alias("path"))
    parsed, _ = feeds.parse_bogie_frames(feeds.split_frames(blobs), ingest_ts=F.lit("2024-01-01").cast("timestamp"))
    return parsed.select(
        F.col("sourceId").alias("source_id"), F.col("assetId").alias("asset_id"), "sequence",
        F.col("payload")["vibration_rms"].cast("double").alias("vibration_rms"),
    )


@query(f"""
    SELECT 'wild-T' || user_id AS source_id, CAST(k % 10 AS INTEGER) AS axles, round(CAST(CAST(value AS FLOAT) AS DOUBLE) + k % 10 - 1, 3) AS max_load
    FROM {EVENTS_SQL} e WHERE k % 10 BETWEEN 1 AND 8""")
def axle_records(spark, folder):
    def encode(batches):
        for b in batches:
            users, ms, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("user_id", "ms", "k"))
            rows = np.zeros(len(users), dtype=feeds.AXLE_RECORD)
            rows["id"] = [f"T{u}".encode() for u in users]
            rows["ms"], rows["axles"] = ms, k % 10
            rows["loads"] = b.column("value").to_numpy()[:, None] + np.arange(8)
            raw = rows.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i:i + 64] for i in range(0, len(raw), 64)], pa.binary())], names=["record"])

    e = events(spark, folder).select("user_id", (F.col("us") / 1000).cast("bigint").alias("ms"), "k", "value")
    parsed, _ = feeds.parse_axle_records(e.mapInArrow(encode, "record binary"))
    loads = F.from_json(F.col("payload")["axle_loads"], "array<double>")
    return parsed.select(
        F.col("sourceId").alias("source_id"), F.size(loads).alias("axles"), F.round(F.col("payload")["max_load"].cast("double"), 3).alias("max_load")
    )


@query(f"""
    SELECT 'e' || event_id AS event_id, {SENSOR_SQL} AS sensor_type, epoch_us(date_trunc('second', ts)) AS ts_us, k AS sequence, value AS drift_ms
    FROM {EVENTS_SQL} e""")
def archive_layout(spark, folder):
    e = events(spark, folder)
    canonical = e.select(
        F.concat(F.lit("e"), "event_id").alias("eventId"), F.lit("s").alias("sourceId"), col_map("event_type", SENSORS, "broken").alias("sensorType"),
        F.lit("a").alias("assetId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), F.col("k").alias("sequence"),
        F.create_map(F.lit("v"), F.col("value").cast("string")).alias("payload"),
        F.struct(F.lit(False).alias("interpolated"), F.lit(0.0).alias("interpolation_pct"), F.lit(True).alias("clock_reliable"), F.col("value").alias("drift_ms")).alias("quality_flags"),
        F.lit("1.0.0").alias("schema_version"),
    )
    rows = archive.archive_rows(canonical, F.lit("z"), F.lit("2024-02-01").cast("timestamp"))
    return rows.select("event_id", "sensor_type", F.unix_micros("timestamp_utc").alias("ts_us"), "sequence", "drift_ms")
