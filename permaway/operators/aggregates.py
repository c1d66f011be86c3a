"""Aggregations. Every groupBy here combines on the map side; no group is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from permaway.functions.risk import risk_tier
from permaway.operators.scan import grouped_quantiles, ordered_scan, previous, row_number, total
from permaway.sources.corridor import class_passengers, class_priority

LATENCY_BUCKETS = [0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, float("inf")]
BATCH_BUCKETS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, float("inf")]
INFERENCE_BUCKETS = [1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]


def window_statistics(
    df: DataFrame, keys: list[str], order: list[str], value: str
) -> DataFrame:
    """Ten time-domain features per window; ``keys`` name the window.

    The mean comes with the neighbour scan, so one shuffle on ``keys`` serves both steps.
    """
    x = F.col(value)
    seen = ordered_scan(
        df.select(*keys, *order, value), keys, order,
        [previous(value, "_before"), total(x, "_sum"), total(F.lit(1), "_n")],
    )
    centre = F.col("_sum") / F.col("_n")
    base = seen.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"),
        F.sqrt(F.avg(x * x)).alias("rms"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.kurtosis(x).alias("_kurt"), F.sum(x * x).alias("energy"),
        F.count_if((x - centre) * (F.col("_before") - centre) < 0).alias("_crossings"),
    )
    spread = F.col("std") > 0
    return base.select(
        *keys, "n",
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("rms", 6).alias("rms"),
        F.round("min", 6).alias("min"), F.round("max", 6).alias("max"),
        F.round(F.col("max") - F.col("min"), 6).alias("peak_to_peak"),
        F.round(F.when(F.col("rms") > 0, F.col("max") / F.col("rms")).otherwise(0.0), 4).alias("crest_factor"),
        F.round(F.when(spread & (F.col("n") > 3), F.coalesce("_kurt", F.lit(0.0))).otherwise(0.0), 4).alias("kurtosis"),
        F.round(F.col("_crossings") / F.col("n"), 4).alias("zcr"),
        F.round("energy", 2).alias("energy"),
    )


def rolling_statistics(
    df: DataFrame, keys: list[str], order: list[str], value: str, size: int, *,
    block: int = 100_000,
) -> DataFrame:
    """Statistics of the last ``size`` rows at every row.

    Rows are numbered per key and cut into blocks; each block also gets the
    ``size - 1`` rows before it, so a hot key is spread over many tasks.
    """
    block = max(block, size)
    numbered = ordered_scan(df, keys, order, [row_number("_rn")])
    home = F.floor((F.col("_rn") - 1) / block)
    late = F.pmod(F.col("_rn") - 1, F.lit(block)) >= block - (size - 1)
    spread = numbered.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-(size - 1), 0)
    x = F.col(value)
    n = F.count(x).over(frame)
    variance = F.when(n < 2, F.lit(0.0)).otherwise(F.var_pop(x).over(frame))
    out = spread.withColumns(
        {
            "n": n, "mean": F.avg(x).over(frame), "variance": variance, "std": F.sqrt(variance),
            "rms": F.sqrt(F.avg(x * x).over(frame)), "low": F.min(x).over(frame), "high": F.max(x).over(frame),
        }
    )
    return out.filter(F.col("_block") == F.col("_home")).drop("_rn", "_home", "_block")


def stability_index(
    df: DataFrame, keys: list[str], cohort: str, value: str, *, bins: int = 10
) -> DataFrame:
    """Population stability index of cohort ``current`` against ``baseline`` per key, 6 places.

    Bin edges are exact quantiles of both cohorts together; an empty bin counts as 1e-4.
    """
    edges = grouped_quantiles(df, keys, value, [i / bins for i in range(bins + 1)]).drop("n")
    inner = F.slice("quantiles", 2, bins - 1)
    placed = df.filter(F.col(value).isNotNull()).join(edges, keys)
    # The bin is the number of inner edges at or below the value.
    slot = F.aggregate(inner, F.lit(0), lambda acc, e: acc + F.when(e <= F.col(value), 1).otherwise(0))
    counted = placed.groupBy(*keys, slot.alias("_bin")).agg(
        F.count_if(F.col(cohort) == "baseline").alias("_b"), F.count_if(F.col(cohort) == "current").alias("_c")
    )
    per_key = counted.groupBy(*keys).agg(
        F.sum("_b").alias("_bn"), F.sum("_c").alias("_cn"),
        F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("_b", "_c")))).alias("_bins"),  # at most `bins` entries
    )
    share = lambda part, whole: F.when(F.coalesce(part, F.lit(0)) == 0, F.lit(1e-4)).otherwise(part / whole)
    def term(i: Column) -> Column:
        b = share(F.col("_bins")[i]["_b"], F.col("_bn"))
        c = share(F.col("_bins")[i]["_c"], F.col("_cn"))
        return (c - b) * F.log(c / b)

    terms = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), term)
    psi = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return per_key.select(*keys, F.round(psi, 6).alias("psi"))


def stratified_metric(
    df: DataFrame, strata: list[str], metric: Callable[[], Column], *, limit_pct: float = 10.0
) -> DataFrame:
    """A metric per stratum against the overall one; ``metric`` builds the aggregate column.

    All strata and the total come from one pass of grouping sets; the total is
    a single row.
    """
    sets = df.groupingSets([[F.col(s)] for s in strata] + [[]], *[F.col(s) for s in strata]).agg(
        F.grouping_id().alias("_g"), metric().alias("_m"), F.count(F.lit(1)).alias("n_samples")
    )
    everything = (1 << len(strata)) - 1
    name = F.lit(None).cast("string")
    label = F.lit(None).cast("string")
    for i, s in enumerate(strata):
        here = F.col("_g") == everything - (1 << (len(strata) - 1 - i))
        name = F.when(here, F.lit(s)).otherwise(name)
        label = F.when(here, F.col(s).cast("string")).otherwise(label)
    overall = sets.filter(F.col("_g") == everything).select(F.lit(1).alias("_one"), F.col("_m").alias("_overall"))
    parts = sets.filter(F.col("_g") != everything).select(
        name.alias("stratum"), label.alias("category"), "_m", "n_samples", F.lit(1).alias("_one")
    )
    worse = (F.col("_overall") - F.col("_m")) / F.greatest(F.abs("_overall"), F.lit(1e-9)) * 100
    return parts.join(F.broadcast(overall), "_one").select(
        "stratum", "category", F.round("_m", 4).alias("metric"), F.round("_overall", 4).alias("overall"),
        F.round(worse, 2).alias("degradation_pct"), "n_samples", (worse > limit_pct).alias("violation"),
    )


def class_metrics(df: DataFrame, actual: str, predicted: str, *, least_samples: int = 500, gate: float = 0.90) -> DataFrame:
    """Precision, recall and gate per class, from one count of (actual, predicted) pairs."""
    pairs = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("_n"))
    sides = pairs.select(
        F.explode(F.array(F.col(actual), F.col(predicted))).alias("class"), actual, predicted, "_n"
    ).dropDuplicates(["class", actual, predicted])
    hit, said, was = (
        F.col(actual).eqNullSafe(F.col(predicted)), F.col(predicted) == F.col("class"), F.col(actual) == F.col("class")
    )
    total = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0))
    out = sides.groupBy("class").agg(
        total(hit).alias("tp"), total(said & ~hit).alias("fp"), total(was & ~hit).alias("fn"), total(was).alias("samples")
    )
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(0.0)
    return out.withColumns({"precision": ratio("fp"), "recall": ratio("fn")}).withColumn(
        "passed", (F.col("precision") >= gate) & (F.col("recall") >= gate) & (F.col("samples") >= least_samples)
    )


def residual_quantile(
    df: DataFrame, keys: list[str], residual: str, *, q: float = 0.90, default: float = 0.15
) -> DataFrame:
    """Quantile of absolute residuals per key; ``default`` for a key without any."""
    absolute = df.withColumn("_abs", F.abs(residual))
    found = grouped_quantiles(absolute, keys, "_abs", [q]).select(*keys, F.get("quantiles", 0).alias("_q"))
    if not keys:
        return found.select(F.coalesce(F.max("_q"), F.lit(default)).alias("quantile"))
    return df.select(*keys).distinct().join(found, keys, "left").select(
        *keys, F.coalesce("_q", F.lit(default)).alias("quantile")
    )


def gate_stats(decisions: DataFrame, *, recent: int = 200) -> DataFrame:
    """One row: totals by action and tier, rate of authorisation, mean time of the last decisions."""
    is_auth, is_rej = F.col("action") == "AUTHORIZE", F.col("action") == "REJECT"
    totals = decisions.agg(
        F.count(F.lit(1)).alias("total_enqueued"), F.count_if(is_auth).alias("total_authorized"),
        F.count_if(is_rej).alias("total_rejected"),
        *[F.count_if(F.col("risk_tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)],
        F.lit(1).alias("_one"),
    )
    last = (
        decisions.filter(is_auth | is_rej).orderBy(F.col("ts").desc(), F.col("audit_id").desc()).limit(recent)
        .agg(F.coalesce(F.round(F.avg("decision_time_s"), 1), F.lit(0.0)).alias("avg_decision_s"), F.lit(1).alias("_one"))
    )
    decided = F.col("total_authorized") + F.col("total_rejected")
    return totals.join(F.broadcast(last), "_one").drop("_one").withColumn(
        "authorization_rate", F.round(F.col("total_authorized") / F.greatest(decided, F.lit(1)) * 100, 1)
    )


def correlations(df: DataFrame, window: list[str | Column] = []) -> DataFrame:
    """Correlated anomalies: several sensors of one node, and one type on several nodes.

    ``window`` columns (a time window, for example) separate the groups.
    """
    same_node = df.groupBy(*window, "node_id").agg(
        F.countDistinct("sensor_id").alias("parties"), F.count(F.lit(1)).alias("anomaly_count"),
        F.max("severity").alias("severity"), F.avg("confidence").alias("_c"),
    ).filter("parties >= 2")
    same_type = df.groupBy(*window, "anomaly_type").agg(
        F.countDistinct("node_id").alias("parties"), F.count(F.lit(1)).alias("anomaly_count")
    ).filter("parties >= 2")
    carried = [c if isinstance(c, str) else "window" for c in window]
    return same_node.select(
        *carried, F.lit("multi_sensor_same_node").alias("kind"), F.col("node_id").alias("subject"), "parties", "anomaly_count",
        F.col("severity").cast("int").alias("severity"), F.least(F.lit(1.0), F.col("_c") + 0.2).alias("confidence"),
    ).unionByName(
        same_type.select(
            *carried, F.lit("multi_node_same_anomaly").alias("kind"), F.col("anomaly_type").alias("subject"), "parties",
            "anomaly_count", F.lit(2).alias("severity"), F.least(F.lit(1.0), F.col("parties") * 0.3).alias("confidence"),
        )
    )


def delay_status(delay_min: Column) -> Column:
    return F.when(delay_min > 10, "alert").when(delay_min > 3, "delayed").otherwise("on-time")


def corridor_stats(trains: DataFrame, defects: DataFrame) -> DataFrame:
    """One row: active trains, share on time, alerts, highest speed, total delay."""
    t = trains.agg(
        F.count(F.lit(1)).alias("active_trains"),
        F.round(F.count_if(delay_status(F.col("delay_min")) == "on-time") / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100)
        .alias("on_time_pct"),
        F.coalesce(F.max("speed"), F.lit(0)).alias("max_speed"), F.coalesce(F.sum("delay_min"), F.lit(0)).alias("total_delay_min"),
        F.lit(1).alias("_one"),
    )
    d = defects.agg(F.count(F.lit(1)).alias("track_alerts"), F.lit(1).alias("_one"))
    return t.join(F.broadcast(d), "_one").drop("_one")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))


def occupancy(edges: DataFrame) -> DataFrame:
    """Trains on each segment, from the ``runs_on`` edges."""
    return edges.filter(F.col("type") == "runs_on").groupBy(F.col("dst").alias("segment")).agg(
        F.count(F.lit(1)).alias("occupancy")
    )


def neighbours(edges: DataFrame, node: str, edge_type: str) -> DataFrame:
    return edges.filter((F.col("src") == node) & (F.col("type") == edge_type)).select("dst")


def proposal_metrics(assignments: DataFrame) -> DataFrame:
    """Per proposal: total and largest delay, passengers affected, conflicts, risk.

    Assignments carry proposalId, train_class, delay_min and conflicts.
    """
    d = F.abs("delay_min")
    pax = class_passengers(class_priority(F.col("train_class")))
    out = assignments.groupBy("proposalId").agg(
        F.sum(d).alias("total_delay_min"), F.max(d).alias("max_delay_min"),
        F.sum(F.floor(pax * d / 60)).alias("affected_passengers"), F.sum("conflicts").alias("conflicts"),
    )
    risk = F.least(F.lit(4.0), 1.0 + F.col("total_delay_min") / 30 + F.col("conflicts") * 0.3)
    return out.withColumn("risk_score", risk).withColumn("risk_tier", risk_tier(F.col("risk_score")))


def dataset_stats(images: DataFrame, *, least: int = 500) -> DataFrame:
    """Counts by split and class with totals (nulls in a total row), and the minimum check per class."""
    return images.rollup("split", "class").agg(F.count(F.lit(1)).alias("images")).withColumn(
        "enough", F.when(F.col("class").isNotNull() & F.col("split").isNull(), F.col("images") >= least)
    )


def zone_summary(stations: DataFrame) -> DataFrame:
    return stations.groupBy("zone").agg(
        F.count_if(F.col("health") == "HEALTHY").alias("healthy"), F.avg("gpu_pct").alias("mean_gpu_pct"),
        F.sum("qps").alias("total_qps"), F.max("rounds").alias("rounds"),
    )


def scaling_advice(
    ticks: DataFrame, *, up: float = 85.0, down: float = 30.0, target_queue: int = 50
) -> DataFrame:
    """Scaling advice per tick from node loads (tick, available, gpu_pct, queue_depth).

    Spacing the actions is operators.stateful.scaling_actions over the result.
    """
    out = ticks.groupBy("tick").agg(
        F.count_if("available").alias("active"), F.avg(F.when(F.col("available"), F.col("gpu_pct"))).alias("mean_gpu_pct"),
        F.max("queue_depth").alias("queue_depth"),
    )
    busy = (F.col("mean_gpu_pct") > up) | (F.col("queue_depth") > 2 * target_queue)
    idle = (F.col("mean_gpu_pct") < down) & (F.col("queue_depth") < target_queue // 2)
    return out.withColumn("advice", F.when(F.col("active") == 0, "UP").when(busy, "UP").when(idle, "DOWN").otherwise("NONE"))


def retention_report(rows: DataFrame, holds: DataFrame) -> DataFrame:
    """Per category: days to live, archived and purged rows, bytes; the number of active holds beside it."""
    from permaway.operators.joins import retention_days

    report = rows.groupBy("category").agg(
        F.count_if("archived").alias("archived"), F.count_if("purged").alias("purged"), F.sum("bytes").alias("bytes"),
        F.lit(1).alias("_one"),
    ).withColumn("ttl_days", retention_days(F.col("category")))
    active = holds.agg(F.count_if("active").alias("active_holds"), F.lit(1).alias("_one"))
    return report.join(F.broadcast(active), "_one").drop("_one")


def histogram(df: DataFrame, keys: list[str], value: str, buckets: list[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts ``(keys, le, count)``.

    Each row falls into one bucket first; the cumulation runs over the few
    bucket counts of a key.
    """
    slots = F.array(*[F.lit(float(b)) for b in buckets])
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)])
    counts = F.array(*[F.col(f"_b{i}") for i in range(len(buckets))])
    return counted.select(*keys, F.explode(F.arrays_zip(slots.alias("le"), counts.alias("count"))).alias("_z")).select(
        *keys, F.col("_z.le").alias("le"), F.col("_z.count").alias("count")
    )


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket that reaches it.

    In the open last bucket the answer is the highest finite bound.
    """
    rows = F.array_sort(F.collect_list(F.struct("le", "count")))  # one entry per bucket bound
    packed = buckets.groupBy(*keys).agg(rows.alias("_r"))
    r = F.col("_r")
    rank = F.element_at(r, -1)["count"] * F.lit(q)
    below = F.size(F.filter(r, lambda x: x["count"] < rank))
    at = F.least(below, F.size(r) - 1)
    low = F.when(at > 0, F.get(r, at - 1)["le"]).otherwise(0.0)
    seen = F.when(at > 0, F.get(r, at - 1)["count"]).otherwise(0)
    high, upto = F.get(r, at)["le"], F.get(r, at)["count"]
    inside = low + (high - low) * (rank - seen) / F.nullif(upto - seen, F.lit(0))
    return packed.select(*keys, F.when(high == float("inf"), low).otherwise(inside).alias("quantile"))


def error_ratio(df: DataFrame, service: str = "service", code: str = "code", value: str = "value", limit: float = 0.05) -> DataFrame:
    """Services whose share of 5xx responses is above the limit."""
    bad = F.sum(F.when(F.col(code).startswith("5"), F.col(value)).otherwise(0))
    return df.groupBy(service).agg((bad / F.nullif(F.sum(value), F.lit(0))).alias("ratio")).filter(F.col("ratio") > limit)


def lag_by_group(df: DataFrame) -> DataFrame:
    return df.groupBy("consumer_group", "topic").agg(F.sum("lag").alias("lag"))


def mae_growth(df: DataFrame, cohort: str, full: str, reduced: str, *, limit: float = 0.15) -> DataFrame:
    """Mean absolute error of two cohorts and its relative growth; one pass, one row."""
    err = F.abs(F.col("y") - F.col("yhat"))
    side = lambda c: F.avg(F.when(F.col(cohort) == c, err))
    out = df.agg(side(full).alias("mae_full"), side(reduced).alias("mae_reduced"))
    growth = (F.col("mae_reduced") - F.col("mae_full")) / F.greatest(F.col("mae_full"), F.lit(1e-9))
    return out.withColumn("growth", growth).withColumn("passed", F.col("growth") <= limit)


def top_attribution(df: DataFrame, key: str, importances: str, names: list[str], *, top: int = 3) -> DataFrame:
    """The largest normalised importances per row with their names, 4 places."""
    total = F.aggregate(importances, F.lit(0.0), lambda acc, x: acc + x)
    base = F.when(total == 0, F.lit(1.0)).otherwise(total)
    # Highest score first, the earlier feature on a tie.
    ranked = F.sort_array(
        F.transform(importances, lambda x, i: F.struct((x / base).alias("s"), (-i).alias("i"))), asc=False
    )
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(key, F.posexplode(F.slice(ranked, 1, top)).alias("rank", "_r")).select(
        key, (F.col("rank") + 1).alias("rank"), F.get(labels, -F.col("_r.i")).alias("feature"),
        F.round("_r.s", 4).alias("contribution"),
    )


def interval_coverage(df: DataFrame, *, least: float = 0.80) -> DataFrame:
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage")).withColumn(
        "passed", F.col("coverage") >= least
    )


def robustness(df: DataFrame, metric: Callable[[str, str], Column], *, limit: float = 0.15) -> DataFrame:
    """Metric on clean and perturbed predictions (columns y, clean, perturbed) and its drop."""
    out = df.agg(metric("y", "clean").alias("clean_metric"), metric("y", "perturbed").alias("adversarial_metric"))
    drop = (F.col("clean_metric") - F.col("adversarial_metric")) / F.greatest(F.abs("clean_metric"), F.lit(1e-9))
    return out.withColumn("degradation", drop).withColumn("passed", F.col("degradation") <= limit)


def energy_efficiency(df: DataFrame) -> DataFrame:
    """Operations per watt-hour by node and day."""
    return df.groupBy("node_id", F.to_date("ts").alias("day")).agg(
        (F.sum("ops") / F.nullif(F.sum("wh"), F.lit(0.0))).alias("ops_per_wh")
    )


def inference_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model_id", "status").agg(F.count(F.lit(1)).alias("requests"))
