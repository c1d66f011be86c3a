"""Queries on aggregations, quantiles, histograms and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from permaway.functions import arrays
from permaway.operators import aggregates, federated, ordered, rules, stateful
from permaway.plans.registry import EVENTS_SQL, col_map, events, query, table
from permaway.streaming.stateful import windowed_correlations


@query("""
    WITH r AS (SELECT user_id, value, ts, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS win,
        count(*) OVER (PARTITION BY user_id) AS total FROM events),
    f AS (SELECT * FROM r WHERE (win + 1) * 20 <= total),
    m AS (SELECT *, avg(value) OVER (PARTITION BY user_id, win) AS mu, lag(value) OVER (PARTITION BY user_id, win ORDER BY ts, event_id) AS p FROM f)
    SELECT user_id, win, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sqrt(avg(value * value)), 6) AS rms,
      round(max(value) - min(value), 6) AS peak_to_peak, round(max(value) / sqrt(avg(value * value)), 4) AS crest_factor,
      round(kurtosis_pop(value), 4) AS kurtosis, round(count(*) FILTER (WHERE (value - mu) * (p - mu) < 0) / count(*), 4) AS zcr,
      round(sum(value * value), 2) AS energy FROM m GROUP BY user_id, win""")
def window_features(spark, folder):
    windows = ordered.tumbling_windows(events(spark, folder), ["user_id"], ["ts", "event_id"], 20)
    # A window holds 20 rows, so its size needs no check.
    out = aggregates.window_statistics(windows, ["user_id", "win"], ["pos"], "value")
    return out.drop("min", "max")


@query("""
    SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE var_pop(value) OVER w END, 6) AS variance,
      min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, folder):
    out = aggregates.rolling_statistics(events(spark, folder), ["user_id"], ["ts", "event_id"], "value", 10)
    return out.select("event_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "low", "high")


@query("""
    WITH q AS (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM events GROUP BY event_type),
    b AS (SELECT e.event_type, ts >= TIMESTAMP '2024-01-16' AS cur, len(list_filter(edges, lambda x: x <= value)) AS bin FROM events e JOIN q USING (event_type)),
    c AS (SELECT t.event_type, s.bin, (SELECT count(*) FROM b WHERE b.event_type = t.event_type AND b.bin = s.bin AND NOT cur) AS nb,
        (SELECT count(*) FROM b WHERE b.event_type = t.event_type AND b.bin = s.bin AND cur) AS nc FROM q t, (SELECT unnest(range(10)) AS bin) s),
    p AS (SELECT event_type, CASE WHEN nb = 0 THEN 1e-4 ELSE nb / sum(nb) OVER (PARTITION BY event_type) END AS pb,
        CASE WHEN nc = 0 THEN 1e-4 ELSE nc / sum(nc) OVER (PARTITION BY event_type) END AS pc FROM c)
    SELECT event_type, round(sum((pc - pb) * ln(pc / pb)), 6) AS psi FROM p GROUP BY event_type""")
def psi_by_type(spark, folder):
    e = events(spark, folder).withColumn("cohort", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "baseline").otherwise("current"))
    return aggregates.stability_index(e, ["event_type"], "cohort", "value")


@query("""
    SELECT vec_id, round(abs(ln(sqrt(0.02) / sqrt(v)) + (v + power(m - 0.001, 2)) / (2 * 0.02) - 0.5), 6) AS drift FROM (
      SELECT vec_id, avg(x) AS m, greatest(var_pop(x), 1e-8) AS v FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u GROUP BY vec_id) s""")
def kl_drift(spark, folder):
    e = table(spark, folder, "embeddings")
    g = F.col("embedding").cast("array<double>")
    return e.select("vec_id", F.round(arrays.gaussian_divergence(g, 0.001, 0.02), 6).alias("drift"))


@query("""
    WITH j AS (SELECT lang, source, quality, (n_chars > 800)::INTEGER AS yhat FROM documents JOIN labels USING (doc_id)),
    o AS (SELECT avg((quality = yhat)::INTEGER) AS m FROM j),
    s AS (SELECT 'lang' AS stratum, lang AS category, avg((quality = yhat)::INTEGER) AS m, count(*) AS n FROM j GROUP BY lang
      UNION ALL SELECT 'source', source, avg((quality = yhat)::INTEGER), count(*) FROM j GROUP BY source)
    SELECT stratum, category, round(s.m, 4) AS metric, round((o.m - s.m) / o.m * 100, 2) AS degradation_pct, n AS n_samples,
      (o.m - s.m) / o.m * 100 > 10 AS violation FROM s, o""")
def stratified_metric(spark, folder):
    j = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    hit = (F.col("quality") == (F.col("n_chars") > 800).cast("int")).cast("double")
    out = aggregates.stratified_metric(j, ["lang", "source"], lambda: F.avg(hit))
    return out.drop("overall")


@query("""
    WITH p AS (SELECT event_type AS a, CASE WHEN value > 150 THEN 'error' WHEN value > 60 THEN 'click' ELSE event_type END AS b FROM events),
    c AS (SELECT a AS class FROM p UNION SELECT b FROM p)
    SELECT class, count(*) FILTER (WHERE a = class AND b = class) AS tp, count(*) FILTER (WHERE a <> class AND b = class) AS fp,
      count(*) FILTER (WHERE a = class AND b <> class) AS fn,
      round(count(*) FILTER (WHERE a = class AND b = class) / greatest(1, count(*) FILTER (WHERE b = class)), 6) AS "precision",
      round(count(*) FILTER (WHERE a = class AND b = class) / greatest(1, count(*) FILTER (WHERE a = class)), 6) AS recall FROM c, p GROUP BY class""")
def class_metrics(spark, folder):
    said = F.when(F.col("value") > 150, "error").when(F.col("value") > 60, "click").otherwise(F.col("event_type"))
    out = aggregates.class_metrics(events(spark, folder).select("event_type", said.alias("said")), "event_type", "said")
    return out.select("class", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""
    SELECT l_returnflag, round(quantile_cont(abs(l_extendedprice / 100 - l_quantity * 10), 0.9), 6) AS quantile FROM lineitem GROUP BY l_returnflag""")
def interval_quantile(spark, folder):
    l = table(spark, folder, "lineitem").withColumn("residual", F.col("l_extendedprice") / 100 - F.col("l_quantity") * 10)
    return aggregates.residual_quantile(l, ["l_returnflag"], "residual").withColumn("quantile", F.round("quantile", 6))


@query("""
    SELECT count(*) AS n, round(avg((l_extendedprice BETWEEN l_quantity * 900 AND l_quantity * 3000)::INTEGER), 6) AS coverage,
      avg((l_extendedprice BETWEEN l_quantity * 900 AND l_quantity * 3000)::INTEGER) >= 0.8 AS passed FROM lineitem""")
def coverage(spark, folder):
    q = F.col("l_quantity")
    l = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("y"), (q * 900).alias("lower"), (q * 3000).alias("upper"))
    return aggregates.interval_coverage(l).withColumn("coverage", F.round("coverage", 6))


@query("""
    SELECT round(a, 4) AS mae_full, round(b, 4) AS mae_reduced, round((b - a) / a, 6) AS growth, (b - a) / a <= 0.15 AS passed FROM (
      SELECT avg(abs(l_extendedprice - l_quantity * 2000)) FILTER (WHERE l_linestatus = 'O') AS a,
        avg(abs(l_extendedprice - l_quantity * 2000)) FILTER (WHERE l_linestatus = 'F') AS b FROM lineitem) x""")
def mae_growth(spark, folder):
    l = table(spark, folder, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("yhat"))
    out = aggregates.mae_growth(l, "l_linestatus", "O", "F")
    return out.select(F.round("mae_full", 4).alias("mae_full"), F.round("mae_reduced", 4).alias("mae_reduced"), F.round("growth", 6).alias("growth"), "passed")


def _updates(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("round_id"), F.col("vec_id").alias("station_id"), F.col("embedding").cast("array<double>").alias("gradients"),
        (F.col("vec_id") % 7).alias("sample_count"), F.col("vec_id").alias("submitted_at"),
    )


@query("""
    WITH u AS (SELECT label AS round_id, vec_id % 7 AS w, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT round_id, pos, round(sum(x * w) / sum(w) * 0.99, 6) AS average FROM u GROUP BY round_id, pos""")
def fed_average(spark, folder):
    updates = rules.require_float_arrays(_updates(spark, folder), ["gradients"])
    out = federated.federated_average(updates, mu=0.01)
    return out.select("round_id", F.col("pos").cast("bigint").alias("pos"), F.round("average", 6).alias("average"))


@query("""
    WITH u AS (SELECT label AS round_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT round_id, pos, round(avg(x), 6) AS average FROM u GROUP BY round_id, pos""")
def fed_plain_average(spark, folder):
    out = federated.federated_average(_updates(spark, folder), weight=None)
    return out.select("round_id", F.col("pos").cast("bigint").alias("pos"), F.round("average", 6).alias("average"))


@query("""
    WITH n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm, arg_min(x, i) AS x0 FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) * (1 + vec_id % 3) / 2 AS x FROM embeddings) u GROUP BY vec_id)
    SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm > 1 THEN x0 / norm ELSE x0 END, 6) AS first FROM n""")
def clip_vectors(spark, folder):
    g = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 3) / 2)
    e = table(spark, folder, "embeddings").select("vec_id", g.alias("g"))
    return e.select(
        "vec_id", F.round(arrays.l2_norm(F.col("g")), 6).alias("norm"), F.round(F.get(arrays.clip_to_norm(F.col("g")), 0), 6).alias("first")
    )


@query("""
    WITH s AS (SELECT label, vec_id, avg(x) AS m, greatest(var_pop(x), 1e-8) AS v, sqrt(sum(x * x)) AS norm FROM (
        SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u GROUP BY label, vec_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM s
      WHERE norm <= 10 AND abs(ln(sqrt(0.0156) / sqrt(v)) + (v + m * m) / (2 * 0.0156) - 0.5) <= 0.003)
    SELECT label AS round_id, vec_id AS station_id, place FROM f
    WHERE place <= (SELECT ceil(count(*) * 0.6) FROM embeddings e WHERE e.label = f.label)""")
def admission(spark, folder):
    u = _updates(spark, folder)
    out = federated.admit_updates(u, u.select("round_id", "station_id"), max_drift=0.003, global_var=0.0156)
    return out.select("round_id", "station_id", "place")


@query("""
    WITH d AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus IN ('F', 'O'))
    SELECT (SELECT count(*) FROM orders) AS total_enqueued, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_authorized,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_rejected,
      (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS tier_1, (SELECT round(avg(o_totalprice), 1) FROM d WHERE r <= 200) AS avg_decision_s,
      (SELECT round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) * 100, 1) FROM orders) AS authorization_rate""")
def gate_stats(spark, folder):
    d = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("audit_id"), col_map("o_orderstatus", {"F": "AUTHORIZE", "O": "REJECT"}, "OTHER").alias("action"),
        (1 + F.col("o_orderkey") % 3).alias("risk_tier"), F.col("o_totalprice").alias("decision_time_s"), F.col("o_orderdate").alias("ts"),
    )
    return aggregates.gate_stats(d).drop("tier_2", "tier_3")


_FLAGS = "(SELECT ts, 'n' || user_id % 20 AS node_id, user_id AS sensor_id, event_type AS anomaly_type, CAST(k % 3 AS INTEGER) AS severity, k / 100.0 AS confidence, us FROM " + EVENTS_SQL + " e)"


def anomaly_flags(spark, folder):
    return events(spark, folder).select(
        "ts", F.concat(F.lit("n"), F.col("user_id") % 20).alias("node_id"), F.col("user_id").alias("sensor_id"), F.col("event_type").alias("anomaly_type"),
        (F.col("k") % 3).cast("int").alias("severity"), (F.col("k") / 100.0).alias("confidence"),
    )


@query(f"""
    WITH w AS (SELECT *, unnest(range(us // 600000000 - 1, us // 600000000 + 1)) * 600000000 AS start_us FROM {_FLAGS} f)
    SELECT start_us, 'multi_sensor_same_node' AS kind, node_id AS subject, count(DISTINCT sensor_id) AS parties, count(*) AS anomaly_count,
      max(severity) AS severity, round(least(1.0, avg(confidence) + 0.2), 6) AS confidence FROM w GROUP BY start_us, node_id HAVING count(DISTINCT sensor_id) >= 2
    UNION ALL SELECT start_us, 'multi_node_same_anomaly', anomaly_type, count(DISTINCT node_id), count(*), 2, round(least(1.0, count(DISTINCT node_id) * 0.3), 6)
      FROM w GROUP BY start_us, anomaly_type HAVING count(DISTINCT node_id) >= 2""")
def correlated_anomalies(spark, folder):
    out = windowed_correlations(anomaly_flags(spark, folder), length="20 minutes", slide="10 minutes")
    return out.select(
        F.unix_micros("window.start").alias("start_us"), "kind", "subject", "parties", "anomaly_count", "severity", F.round("confidence", 6).alias("confidence")
    )


@query(f"""
    SELECT count(*) AS active_trains, CAST(round(count(*) FILTER (WHERE value <= 3) / count(*) * 100) AS DOUBLE) AS on_time_pct, max(k) AS max_speed,
      round(sum(value), 4) AS total_delay_min, (SELECT count(*) FROM supplier) AS track_alerts FROM {EVENTS_SQL} e""")
def corridor_stats(spark, folder):
    t = events(spark, folder).select(F.col("value").alias("delay_min"), F.col("k").alias("speed"))
    out = aggregates.corridor_stats(t, table(spark, folder, "supplier"))
    return out.withColumn("total_delay_min", F.round("total_delay_min", 4))


@query(f"""
    SELECT user_id AS "proposalId", sum(abs(k - 50)) AS total_delay_min, max(abs(k - 50)) AS max_delay_min,
      CAST(sum(floor(CASE event_type WHEN 'click' THEN 800 WHEN 'view' THEN 0 ELSE 300 END * abs(k - 50) / 60)) AS BIGINT) AS affected_passengers,
      round(least(4.0, 1 + sum(abs(k - 50)) / 30 + count(*) FILTER (WHERE event_type = 'error') * 0.3), 6) AS risk_score FROM {EVENTS_SQL} e GROUP BY user_id""")
def proposal_metrics(spark, folder):
    e = events(spark, folder).select(
        F.col("user_id").alias("proposalId"), col_map("event_type", {"click": "Rajdhani", "view": "Freight"}, "Express").alias("train_class"),
        (F.col("k") - 50).alias("delay_min"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("conflicts"),
    )
    return aggregates.proposal_metrics(e).drop("conflicts", "risk_tier").withColumn("risk_score", F.round("risk_score", 6))


@query("""
    SELECT lang AS split, source AS class, count(*) AS images FROM documents GROUP BY ROLLUP (lang, source)""")
def dataset_stats(spark, folder):
    d = table(spark, folder, "documents").select(F.col("lang").alias("split"), F.col("source").alias("class"))
    return aggregates.dataset_stats(d).drop("enough")


@query("""
    SELECT CAST(n_regionkey AS INTEGER) AS zone, count(*) FILTER (WHERE s_acctbal >= 0) AS healthy, round(avg(s_acctbal / 100), 6) AS mean_gpu_pct,
      sum(s_suppkey) AS total_qps FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey""")
def zone_summary(spark, folder):
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    stations = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_regionkey").alias("zone"), F.when(F.col("s_acctbal") >= 0, "HEALTHY").otherwise("OFFLINE").alias("health"),
        (F.col("s_acctbal") / 100).alias("gpu_pct"), F.col("s_suppkey").alias("qps"), F.lit(1).alias("rounds"),
    )
    return aggregates.zone_summary(stations).drop("rounds").withColumn("mean_gpu_pct", F.round("mean_gpu_pct", 6))


@query(f"""
    WITH t AS (SELECT us // 3600000000 AS tick, count(*) FILTER (WHERE event_type <> 'error') AS active,
        avg(value) FILTER (WHERE event_type <> 'error') AS g, max(k) AS q FROM {EVENTS_SQL} e GROUP BY 1)
    SELECT tick, active, CASE WHEN active = 0 THEN 'UP' WHEN g > 70 OR q > 196 THEN 'UP' WHEN g < 30 AND q < 49 THEN 'DOWN' ELSE 'NONE' END AS advice FROM t""")
def scaling_advice(spark, folder):
    e = events(spark, folder).select(
        F.floor(F.col("us") / 3600000000).alias("tick"), (F.col("event_type") != "error").alias("available"), F.col("value").alias("gpu_pct"), F.col("k").alias("queue_depth")
    )
    advised = aggregates.scaling_advice(e, up=70.0, target_queue=98).select("tick", "active", "advice")
    # Ticks of an hour lie further apart than the cool-down, so it takes no advice away here.
    return stateful.scaling_actions(advised, "tick", F.col("tick") * 3600)


@query("""
    SELECT o_orderpriority AS category, count(*) FILTER (WHERE o_orderstatus = 'F') AS archived, count(*) FILTER (WHERE o_orderstatus = 'P') AS purged,
      sum(o_custkey) AS bytes, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS active_holds FROM orders GROUP BY o_orderpriority""")
def retention_report(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("archived"), (F.col("o_orderstatus") == "P").alias("purged"),
        F.col("o_custkey").alias("bytes"),
    )
    holds = table(spark, folder, "customer").select((F.col("c_acctbal") < 0).alias("active"))
    return aggregates.retention_report(o, holds).drop("ttl_days")


_BUCKETS = "unnest([0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 'inf'::DOUBLE])"


@query(f"""
    SELECT l_returnflag, CAST(b.le AS DOUBLE) AS le, count(*) FILTER (WHERE l_quantity / 5 <= b.le) AS count
    FROM lineitem, (SELECT {_BUCKETS} AS le) b GROUP BY l_returnflag, b.le""")
def latency_buckets(spark, folder):
    l = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_quantity") / 5).alias("seconds"))
    return aggregates.histogram(l, ["l_returnflag"], "seconds")


@query(f"""
    WITH h AS (SELECT l_returnflag, b.le, count(*) FILTER (WHERE l_quantity / 5 <= b.le) AS c FROM lineitem, (SELECT {_BUCKETS} AS le) b GROUP BY l_returnflag, b.le),
    w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(c) OVER o, 0) AS below, max(c) OVER (PARTITION BY l_returnflag) * 0.9 AS rank FROM h WINDOW o AS (PARTITION BY l_returnflag ORDER BY le))
    SELECT l_returnflag, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (c - below) END, le), 6) AS quantile FROM w WHERE c >= rank GROUP BY l_returnflag""")
def bucket_quantile(spark, folder):
    out = aggregates.bucket_quantile(latency_buckets(spark, folder), ["l_returnflag"], 0.9)
    return out.withColumn("quantile", F.round("quantile", 6))


@query("""
    SELECT user_id AS service, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / sum(value), 6) AS ratio FROM events GROUP BY user_id
    HAVING sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / sum(value) > 0.25""")
def error_ratio(spark, folder):
    e = events(spark, folder).select(F.col("user_id").alias("service"), F.when(F.col("event_type") == "error", "503").otherwise("200").alias("code"), "value")
    return aggregates.error_ratio(e, limit=0.25).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT user_id % 9 AS consumer_group, event_type AS topic, CAST(sum(k) AS BIGINT) AS lag FROM {EVENTS_SQL} e GROUP BY 1, 2")
def lag_by_group(spark, folder):
    e = events(spark, folder).select((F.col("user_id") % 9).alias("consumer_group"), F.col("event_type").alias("topic"), F.col("k").alias("lag"))
    return aggregates.lag_by_group(e)


@query("""
    WITH u AS (SELECT vec_id, unnest(range(8)) AS i, abs(CAST(unnest(embedding[1:8]) AS DOUBLE)) AS x FROM embeddings),
    r AS (SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM u)
    SELECT vec_id, rank, 'f' || i AS feature, round(s, 4) AS contribution FROM r WHERE rank <= 3""")
def top3_attribution(spark, folder):
    importance = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), F.abs)
    e = table(spark, folder, "embeddings").select("vec_id", importance.alias("w"))
    return aggregates.top_attribution(e, "vec_id", "w", [f"f{i}" for i in range(8)]).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
    WITH u AS (SELECT vec_id, unnest(range(len(embedding))) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings),
    r AS (SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM u)
    SELECT vec_id, rank, 'f' || i AS feature, round(s, 4) AS contribution FROM r WHERE rank <= 3""")
def top3_of_all_entries(spark, folder):
    """All 64 numbers of an embedding as importances; top3_attribution ranks the first 8, as many as the source has features."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("w"))
    return aggregates.top_attribution(e, "vec_id", "w", [f"f{i}" for i in range(64)]).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
    SELECT round(a, 6) AS clean_metric, round(b, 6) AS adversarial_metric, round((a - b) / a, 6) AS degradation, (a - b) / a <= 0.15 AS passed FROM (
      SELECT avg((l_returnflag = CASE WHEN l_tax > 0.04 THEN 'N' ELSE 'A' END)::INTEGER) AS a, avg((l_returnflag = CASE WHEN l_tax > 0.05 THEN 'N' ELSE 'R' END)::INTEGER) AS b FROM lineitem) x""")
def robustness(spark, folder):
    l = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("y"), F.when(F.col("l_tax") > 0.04, "N").otherwise("A").alias("clean"), F.when(F.col("l_tax") > 0.05, "N").otherwise("R").alias("perturbed")
    )
    out = aggregates.robustness(l, lambda y, p: F.avg((F.col(y) == F.col(p)).cast("double")))
    return out.select(*[F.round(c, 6).alias(c) for c in ("clean_metric", "adversarial_metric", "degradation")], "passed")


@query("""
    SELECT o_custkey AS node_id, epoch_us(o_orderdate) AS day_us, round(sum(o_orderkey) / sum(o_totalprice), 6) AS ops_per_wh FROM orders GROUP BY 1, 2""")
def energy_efficiency(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("node_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ops"), F.col("o_totalprice").alias("wh")
    )
    out = aggregates.energy_efficiency(o)
    return out.select("node_id", F.unix_micros(F.col("day").cast("timestamp")).alias("day_us"), F.round("ops_per_wh", 6).alias("ops_per_wh"))


@query("SELECT p_brand AS model_id, p_type AS status, count(*) AS requests FROM part GROUP BY 1, 2")
def inference_counts(spark, folder):
    return aggregates.inference_counts(table(spark, folder, "part").select(F.col("p_brand").alias("model_id"), F.col("p_type").alias("status")))
