"""Queries on joins: equi, range, nearest, interval, conflict and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from permaway.operators import joins
from permaway.plans.registry import EVENTS_SQL, col_map, events, query, table

SEGMENTS_SQL = "(SELECT n_name AS segment, n_nationkey AS seg_order, n_nationkey * 4.0 AS start_km, n_nationkey * 4.0 + 6 AS end_km, 60 + n_nationkey AS max_speed FROM nation)"


def nation_segments(spark, folder):
    n = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("segment"), n.alias("seg_order"), (n * 4.0).alias("start_km"), (n * 4.0 + 6).alias("end_km"),
        (F.lit(60) + n).alias("max_speed"),
    )


@query("""
    SELECT c_custkey AS src, c_nationkey AS dst, 'occupies' AS type FROM customer
    WHERE c_acctbal >= 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def station_edges(spark, folder):
    station = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).otherwise("")
    trains = table(spark, folder, "customer").select(F.col("c_custkey").alias("trainId"), station.alias("stationId"))
    stations = table(spark, folder, "supplier").select(F.col("s_nationkey").cast("string").alias("id")).distinct()
    return joins.station_edges(trains, stations).select("src", F.col("dst").cast("int").alias("dst"), "type")


@query("""
    SELECT p_partkey AS src, d.d AS dst, 'connects' AS type
    FROM (SELECT p_partkey, unnest([p_size, p_size + 3, p_size + 40]) AS d FROM part) d
    WHERE d.d IN (SELECT p_size FROM part)""")
def segment_edges(spark, folder):
    p = table(spark, folder, "part")
    stations = p.select(F.col("p_partkey").alias("id"), F.array("p_size", F.col("p_size") + 3, F.col("p_size") + 40).alias("connected"))
    return joins.segment_edges(stations, p.select(F.col("p_size").alias("id")).distinct())


@query(f"""
    SELECT event_id, arg_min(segment, seg_order) AS segment, coalesce(min(max_speed) FILTER (WHERE seg_order = m), 100) AS max_speed FROM (
      SELECT e.event_id, s.*, min(s.seg_order) OVER (PARTITION BY e.event_id) AS m
      FROM (SELECT event_id, floor(value * 2) / 2 AS km FROM events) e LEFT JOIN {SEGMENTS_SQL} s ON e.km BETWEEN s.start_km AND s.end_km) j
    GROUP BY event_id""")
def range_to_segment(spark, folder):
    points = events(spark, folder).select("event_id", (F.floor(F.col("value") * 2) / 2).alias("km"))
    out = joins.range_lookup(
        points, nation_segments(spark, folder), at="km", order="seg_order", start="start_km", end="end_km",
        keep=["segment", "max_speed"], point_id="event_id",
    )
    return out.select("event_id", "segment", F.coalesce("max_speed", F.lit(100)).alias("max_speed"))


@query("""
    WITH c AS (SELECT c_custkey, floor(abs(c_acctbal)) / 100 AS km FROM customer),
    j AS (SELECT c.*, n_name, abs(c.km - (n_nationkey * 2.9 + 0.001)) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c.km - (n_nationkey * 2.9 + 0.001)), n_nationkey) AS r
      FROM c, nation)
    SELECT c_custkey, n_name AS nearest, round(d, 6) AS distance FROM j WHERE r = 1 AND d < 5""")
def nearest_station(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", (F.floor(F.abs("c_acctbal")) / 100).alias("km"))
    s = table(spark, folder, "nation").select("n_name", (F.col("n_nationkey") * 2.9 + 0.001).alias("place_km"))
    out = joins.nearest_lookup(c, s, at="km", place_at="place_km", place_id="n_name", point_id="c_custkey", within=5.0)
    return out.select("c_custkey", "nearest", F.round("distance", 6).alias("distance"))


@query("""
    SELECT p_partkey, CASE WHEN d < 2 THEN 'red' WHEN d < 5 THEN 'yellow' ELSE 'green' END AS aspect FROM (
      SELECT p_partkey, min(abs(p_partkey * 1.7 - abs(s_acctbal) / 3)) AS d FROM part, supplier GROUP BY p_partkey) x""")
def signal_aspect(spark, folder):
    signals = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") * 1.7).alias("at_km"))
    trains = table(spark, folder, "supplier").select((F.abs("s_acctbal") / 3).alias("km"))
    return joins.signal_aspects(signals, trains, signal="p_partkey", km="at_km").select("p_partkey", "aspect")


_TRACK = "(SELECT p_partkey AS id, p_partkey * 0.5 AS start_km, p_partkey * 0.5 + 0.5 + p_size / 100.0 AS end_km FROM part)"
_DEFECTS = "(SELECT floor(abs(s_acctbal)) / 8 AS start_km, floor(abs(s_acctbal)) / 8 + s_suppkey % 4 * 0.75 AS end_km FROM supplier)"


def _track(spark, folder):
    start = F.col("p_partkey") * 0.5
    segments = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), start.alias("start_km"), (start + 0.5 + F.col("p_size") / 100.0).alias("end_km")
    )
    at = F.floor(F.abs("s_acctbal")) / 8
    defects = table(spark, folder, "supplier").select(at.alias("start_km"), (at + F.col("s_suppkey") % 4 * 0.75).alias("end_km"))
    return segments, defects


@query(f"""
    SELECT id, CAST(EXISTS (SELECT 1 FROM {_DEFECTS} d WHERE d.start_km BETWEEN t.start_km AND t.end_km
      OR d.end_km BETWEEN t.start_km AND t.end_km) AS INTEGER) AS has_defect FROM {_TRACK} t""")
def defect_touch(spark, folder):
    return joins.defect_marks(*_track(spark, folder)).select("id", "has_defect")


@query(f"""
    SELECT id, CAST(EXISTS (SELECT 1 FROM {_DEFECTS} d WHERE d.start_km <= t.end_km AND d.end_km >= t.start_km) AS INTEGER) AS has_defect
    FROM {_TRACK} t""")
def defect_overlap(spark, folder):
    return joins.defect_marks(*_track(spark, folder), mode="overlap").select("id", "has_defect")


@query("""
    SELECT c_custkey, r_name AS zone FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def zone_lookup(spark, folder):
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    zones = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("zone")).agg(
        F.collect_list(F.col("n_nationkey").cast("string")).alias("stations")  # the stations of one zone
    )
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("station"))
    return joins.zone_of(c, zones, "station").select("c_custkey", "zone")


_SLOTS = """(SELECT o_orderkey AS id, o_orderpriority || o_orderstatus AS segment, o_custkey % 7 AS platform, o_custkey AS train,
    epoch_us(o_orderdate) AS enter, epoch_us(o_orderdate) + (o_orderkey % 3 - (CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 0 END)) * 43200000000 AS leave FROM orders)"""


def order_slots(spark, folder):
    o = table(spark, folder, "orders")
    half_days = F.col("o_orderkey") % 3 - F.when(F.col("o_orderkey") % 50 == 0, 2).otherwise(0)
    return o.select(
        F.col("o_orderkey").alias("slot_id"), F.concat("o_orderpriority", "o_orderstatus").alias("segmentId"),
        (F.col("o_custkey") % 7).alias("platform"), F.col("o_custkey").alias("trainId"), F.col("o_custkey").alias("proposalId"),
        F.col("o_orderdate").alias("enterAt"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + half_days * 43200000000).alias("exitAt"),
    )


def _overlap(keys: str, extra: str = "") -> str:
    return f"""EXISTS (SELECT 1 FROM {_SLOTS} b WHERE {keys} AND (b.enter < a.enter OR (b.enter = a.enter AND b.id < a.id))
      AND greatest(a.enter, b.enter) < least(a.leave, b.leave) {extra})"""


@query(f"SELECT id AS slot_id, {_overlap('a.segment = b.segment')} AS conflict FROM {_SLOTS} a")
def slot_conflicts(spark, folder):
    return joins.slot_conflicts(order_slots(spark, folder), ["segmentId"]).select("slot_id", "conflict")


@query(f"SELECT id AS slot_id, {_overlap('a.segment = b.segment AND a.platform = b.platform')} AS conflict FROM {_SLOTS} a")
def platform_conflicts(spark, folder):
    return joins.slot_conflicts(order_slots(spark, folder), ["segmentId", "platform"]).select("slot_id", "conflict")


@query(f"SELECT id AS slot_id, {_overlap('a.segment = b.segment', 'AND a.train <> b.train')} AS conflict FROM {_SLOTS} a")
def rival_conflicts(spark, folder):
    return joins.slot_conflicts(order_slots(spark, folder), ["segmentId"], same_train=False).select("slot_id", "conflict")


@query(f"""
    SELECT train AS "proposalId", NOT bool_or({_overlap('a.train = b.train AND a.segment = b.segment')}) AS conflict_free
    FROM {_SLOTS} a GROUP BY train""")
def conflict_free(spark, folder):
    return joins.conflict_free(order_slots(spark, folder))


@query("""
    SELECT c_custkey, coalesce(g.gradient, 0::DOUBLE) AS gradient, coalesce(g.radius, 0::DOUBLE) AS curve_radius
    FROM customer LEFT JOIN (SELECT n_nationkey, n_nationkey / 1000::DOUBLE AS gradient, n_nationkey * 100::DOUBLE AS radius FROM nation) g
      ON c_nationkey = n_nationkey AND c_custkey % 2 = 0""")
def geometry_lookup(spark, folder):
    n = F.col("n_nationkey")
    g = table(spark, folder, "nation").select(
        (20 + n / 100).alias("lat"), F.lit(77.1234).alias("lon"), (n / 1000.0).alias("gradient"), (n * 100.0).alias("curve_radius")
    )
    c = table(spark, folder, "customer").select(
        "c_custkey", (20 + F.col("c_nationkey") / 100 + 0.00001).alias("lat"), F.when(F.col("c_custkey") % 2 == 0, 77.12342).otherwise(70.0).alias("lon")
    )
    return joins.geometry_lookup(c, g).select("c_custkey", "gradient", "curve_radius")


@query("""
    SELECT o_orderkey AS advisory_id FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))""")
def undecided(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("advisory_id"))
    d = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("advisory_id"), col_map("l_returnflag", {"A": "AUTHORIZE", "R": "REJECT"}, "VIEW").alias("action")
    )
    return joins.undecided(o, d)


_DUE = {"1-URGENT": "raw_sensor_events", "2-HIGH": "telemetry_metrics", "3-MEDIUM": "security_anomaly", "4-NOT SPECIFIED": "model_artifacts"}


@query("""
    WITH r AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 90 WHEN '2-HIGH' THEN 30 WHEN '3-MEDIUM' THEN 365 WHEN '4-NOT SPECIFIED' THEN NULL ELSE 365 END AS days FROM orders),
    s AS (SELECT TIMESTAMP '1995-01-01' + to_days(CAST(n_nationkey * 90 AS INTEGER)) AS a, TIMESTAMP '1995-01-01' + to_days(CAST(n_nationkey * 90 + n_regionkey * 12 AS INTEGER)) AS z FROM nation)
    SELECT o_orderkey FROM r WHERE o_orderdate < TIMESTAMP '2000-06-01' - to_days(CAST(days AS INTEGER))
      AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
      AND NOT EXISTS (SELECT 1 FROM s WHERE o_orderdate BETWEEN a AND z)""")
def retention_due(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("alert_id"), F.col("o_orderdate").alias("ts"),
        col_map("o_orderpriority", _DUE, "authorization_events").alias("category"),
    )
    day = lambda n: F.lit("1995-01-01").cast("timestamp") + F.make_interval(days=n)
    by_id = table(spark, folder, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("alert_id"), F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit(True).alias("active")
    )
    by_time = table(spark, folder, "nation").select(
        F.lit(None).cast("bigint").alias("alert_id"), day(F.col("n_nationkey") * 90).alias("start"),
        day(F.col("n_nationkey") * 90 + F.col("n_regionkey") * 12).alias("end"), F.lit(True).alias("active"),
    )
    as_of = F.lit("2000-06-01").cast("timestamp")
    return joins.retention_due(rows, by_id.unionByName(by_time), as_of).select(F.col("row_id").alias("o_orderkey"))


@query("""
    WITH d AS (SELECT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'error' AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 60 SECOND) AS hit
      FROM events p WHERE event_type = 'purchase')
    SELECT count(*) AS injected, count(*) FILTER (WHERE hit) AS detected, round(count(*) FILTER (WHERE hit) / count(*), 3) AS detection_rate,
      round(count(*) FILTER (WHERE hit) / count(*), 3) >= 0.8 AS passed FROM d""")
def detection_rate(spark, folder):
    e = events(spark, folder)
    patterns = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("pattern_id"), "ts")
    return joins.detection_rate(patterns, e.filter("event_type = 'error'"))


@query("""
    WITH live AS (SELECT o_orderpriority AS model_id, arg_max(o_totalprice, o_orderkey) AS deployed FROM orders
        WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1),
    cand AS (SELECT o_orderpriority AS model_id, round(avg(o_totalprice), 6) AS candidate FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
    SELECT coalesce(b.model_id, c.model_id) AS model_id, 'total' AS metric, deployed, candidate FROM
      (SELECT * FROM live UNION ALL SELECT '5-LOW', 42.0) b FULL JOIN cand c ON b.model_id = c.model_id""")
def baseline_join(spark, folder):
    o = table(spark, folder, "orders")
    runs = o.select(
        F.col("o_orderpriority").alias("model_id"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")).alias("deployed"),
        F.col("o_orderkey").alias("start_time"), F.create_map(F.lit("total"), F.col("o_totalprice")).alias("metrics"),
    )
    candidate = o.filter("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_orderpriority").alias("model_id")).agg(
        F.lit("total").alias("metric"), F.round(F.avg("o_totalprice"), 6).alias("value")
    )
    registry = o.select(F.col("o_orderpriority").alias("model_id")).distinct().select("model_id", F.lit("total").alias("metric"), F.lit(42.0).alias("value"))
    return joins.deployed_baseline(runs, candidate, registry)


@query("""
    SELECT p_partkey AS inference_id, s_suppkey + 1 AS advisory_id, c_mktsegment AS action, n_name AS hazard_id
    FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = s_suppkey + 1 LEFT JOIN nation ON n_nationkey = s_suppkey + 1""")
def lineage_chain(spark, folder):
    return joins.lineage(
        table(spark, folder, "part").select(F.col("p_partkey").alias("inference_id")),
        table(spark, folder, "supplier").select(F.col("s_suppkey").alias("inference_id"), (F.col("s_suppkey") + 1).alias("advisory_id")),
        table(spark, folder, "customer").select(F.col("c_custkey").alias("advisory_id"), F.col("c_mktsegment").alias("action")),
        table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("linked_advisory_id"), F.col("n_name").alias("hazard_id")),
    ).select("inference_id", "advisory_id", "action", "hazard_id")


@query("""
    WITH s AS (SELECT c.value AS km, (SELECT v.value FROM events v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND v.ts <= c.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS rk
      FROM events c WHERE event_type = 'click')
    SELECT count(rk) AS steps, round(avg(abs(km - rk) * 1000), 4) AS mae_m, avg(abs(km - rk) * 1000) <= 500 AS passed FROM s""")
def position_error(spark, folder):
    e = events(spark, folder).select("event_id", "event_type", F.col("user_id").alias("train"), "ts", F.col("value").alias("km"))
    out = joins.position_error(
        e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type", "event_id"), row_id="event_id"
    )
    return out.withColumn("mae_m", F.round("mae_m", 4))


@query("""
    WITH r AS (SELECT l_orderkey AS advisory_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, 1 + l_orderkey % 3 AS tier, l_suppkey % 5 AS controller,
        CASE WHEN l_partkey % 6 = 5 THEN 'REJECT' WHEN l_partkey % 11 = 10 THEN 'HOLD' ELSE 'AUTHORIZE' END AS action,
        CASE l_suppkey % 5 WHEN 0 THEN 'SENIOR_OC' WHEN 1 THEN 'SUPERVISOR' WHEN 2 THEN 'SENIOR_OC' WHEN 3 THEN 'SENIOR_OC' ELSE 'OC' END AS role FROM lineitem),
    ok AS (SELECT *, CASE role WHEN 'SENIOR_OC' THEN TRUE WHEN 'OC' THEN tier >= 2 ELSE tier = 3 END AS allowed FROM r),
    f AS (SELECT *, min(n) FILTER (WHERE allowed AND action = 'AUTHORIZE') OVER w AS first_n,
        arg_min(controller, n) FILTER (WHERE allowed AND action = 'AUTHORIZE') OVER w AS first_by FROM ok WINDOW w AS (PARTITION BY advisory_id)),
    c AS (SELECT *, min(CASE WHEN allowed AND (action = 'REJECT' OR action = 'AUTHORIZE' AND (tier <> 1 OR n > first_n AND controller <> first_by)) THEN n END)
        OVER (PARTITION BY advisory_id) AS closed_n FROM f)
    SELECT advisory_id, line, part, supp, price, CASE WHEN n > closed_n THEN 'NOT_FOUND' WHEN NOT allowed THEN 'REFUSED_ROLE' WHEN action = 'REJECT' THEN 'REJECTED'
      WHEN action = 'HOLD' THEN 'INVALID_ACTION' WHEN tier <> 1 THEN 'AUTHORIZED' WHEN n = first_n THEN 'AWAITING_SECOND_AUTH'
      WHEN controller = first_by THEN 'REFUSED_SAME_CONTROLLER' ELSE 'AUTHORIZED' END AS status FROM c""")
def dual_control(spark, folder):
    part = F.col("l_partkey")
    requests = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("advisory_id"), (1 + F.col("l_orderkey") % 3).alias("risk_tier"), (F.col("l_suppkey") % 5).alias("controller"),
        F.when(part % 6 == 5, "reject").when(part % 11 == 10, "hold").otherwise("authorize").alias("action"),
        F.col("l_linenumber").alias("line"), part.alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
    )
    # The fifth controller is not listed.
    key = F.col("r_regionkey").cast("bigint")
    controllers = table(spark, folder, "region").filter("r_regionkey < 4").select(
        key.alias("controller"), F.when(F.col("r_regionkey") == 1, "SUPERVISOR").otherwise("SENIOR_OC").alias("role")
    )
    order = ["line", "part", "supp", "price"]
    return joins.gate_decisions(requests, controllers, order).select("advisory_id", *order, "status")


@query("""
    SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 430::DOUBLE WHEN 'FURNITURE' THEN 1400::DOUBLE ELSE 580::DOUBLE END AS mass_t,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 1.5::DOUBLE WHEN 'FURNITURE' THEN 2.5::DOUBLE ELSE 2::DOUBLE END AS reaction_s FROM customer""")
def train_config(spark, folder):
    c = joins.train_config(col_map("c_mktsegment", {"MACHINERY": "vande_bharat", "FURNITURE": "wdp4d_mail"}, "unknown"))
    return table(spark, folder, "customer").select("c_custkey", c["mass_t"].alias("mass_t"), c["reaction_s"].alias("reaction_s"))


@query("""
    WITH a AS (SELECT event_id, event_type, user_id || '/' || strftime(ts, '%Y-%m-%d') AS component FROM events)
    SELECT event_id, component FROM a WHERE event_type <> 'click' OR component NOT IN (SELECT component FROM a WHERE event_type = 'error')""")
def inhibited(spark, folder):
    a = events(spark, folder).select(
        "event_id", F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("component"),
        col_map("event_type", {"error": "critical", "click": "warning"}, "info").alias("severity"),
    )
    return joins.uninhibited(a).select("event_id", "component")


@query("""
    WITH d AS (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS day FROM events)
    SELECT 'and' AS op, count(*) AS n FROM d l WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM d r WHERE r.event_type = 'click' AND r.user_id = l.user_id AND r.day = l.day)
    UNION ALL SELECT 'or', (SELECT count(*) FROM d WHERE event_type = 'error') + (SELECT count(*) FROM d r WHERE event_type = 'click'
      AND NOT EXISTS (SELECT 1 FROM d l WHERE l.event_type = 'error' AND r.user_id = l.user_id AND r.day = l.day))
    UNION ALL SELECT 'absent', CAST(NOT EXISTS (SELECT 1 FROM d WHERE event_type = 'nothing') AS BIGINT)""")
def metric_sets(spark, folder):
    d = events(spark, folder).select("event_type", "user_id", F.to_date("ts").alias("day")).distinct()
    left, right = d.filter("event_type = 'error'"), d.filter("event_type = 'click'")
    on = ["user_id", "day"]
    counted = lambda name, df: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    absent = joins.series_absent(d.withColumnRenamed("event_type", "metric"), "nothing")
    return counted("and", joins.series_and(left, right, on)).unionByName(counted("or", joins.series_or(left, right, on))).unionByName(counted("absent", absent))


@query("""
    SELECT o_orderkey, p.p_name AS training_name, q.p_name AS eval_name FROM orders LEFT JOIN part p ON p.p_partkey = o_custkey
      LEFT JOIN part q ON q.p_partkey = o_orderkey""")
def dataset_links(spark, folder):
    models = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("training_version_id"), F.col("o_orderkey").alias("eval_version_id")
    )
    versions = table(spark, folder, "part").select(F.col("p_partkey").alias("dataset_version_id"), F.col("p_name").alias("dataset_name"))
    return joins.dataset_links(models, versions).select("o_orderkey", "training_name", "eval_name")


@query("""
    SELECT c_custkey AS alert_id, o.officer, o.d AS ack_us, o.d IS NULL AS open FROM customer LEFT JOIN (
      SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS officer, max(o_orderkey) AS d FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def acknowledged(spark, folder):
    acks = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("alert_id"), F.col("o_orderkey").alias("officer"), F.timestamp_micros("o_orderkey").alias("acknowledged_at")
    )
    out = joins.acknowledged(table(spark, folder, "customer").select(F.col("c_custkey").alias("alert_id")), acks)
    return out.select("alert_id", "officer", F.unix_micros("acknowledged_at").alias("ack_us"), "open")


@query("""
    SELECT n_name AS model, CAST(NULL AS BIGINT) AS node_id, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0 AND s_nationkey % 4 <> 0) AS healthy_nodes
    FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT n_name, CAST(n_nationkey AS BIGINT), NULL FROM nation WHERE n_regionkey <> 0
    UNION ALL SELECT n_name, CAST(n_nationkey + 100 AS BIGINT), NULL FROM nation WHERE n_regionkey <> 0""")
def rollout_targets(spark, folder):
    nodes = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") >= 0).alias("alive"),
        F.when(F.col("s_nationkey") % 4 == 0, "OVERLOADED").otherwise("HEALTHY").alias("health"),
    )
    key = F.col("n_nationkey").cast("bigint")
    deployments = table(spark, folder, "nation").select(
        F.col("n_name").alias("model"), F.when(F.col("n_regionkey") == 0, F.array().cast("array<bigint>")).otherwise(F.array(key, key + 100)).alias("targets")
    )
    return joins.rollout_targets(deployments, nodes)
