"""Sorted queues, top-k, capacities and set operations.

Global top-k uses ``orderBy().limit()``, which keeps k rows per task before
the final merge. Per-key caps use row_number with a constant bound, which
Spark also cuts on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from permaway.operators.ordered import escalation_timeout
from permaway.operators.scan import ordered_scan, row_number

SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
# Priority -> queue capacity (fixed values).
QUEUE_CAPACITY = {0: 100, 1: 200, 2: 500, 3: 500}


def advisory_queue(df: DataFrame, as_of_s: Column, created_s: Column) -> DataFrame:
    """Open advisories by risk, with age and time to escalation in whole seconds."""
    age = as_of_s - created_s
    timeout = escalation_timeout(F.col("risk_tier"))
    return df.withColumns(
        {
            "age_s": F.rint(age).cast("bigint"),
            "to_escalation_s": F.greatest(F.lit(0), F.rint(timeout - age).cast("bigint")),
        }
    ).orderBy(F.col("risk_score").desc(), "advisory_id")


def severity_rank(severity: Column) -> Column:
    """Rank by severity, most severe first; a missing severity counts as LOW, an unknown one comes first."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.coalesce(severity, F.lit("LOW")))
    return (place - 1).cast("int")


def top_pending(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most severe rows and, on each, how many remain beside them."""
    best = df.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", key).limit(k)
    rest = df.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("remaining"), F.lit(1).alias("_one"))
    return best.withColumn("_one", F.lit(1)).join(F.broadcast(rest), "_one").drop("_one")


def newest(df: DataFrame, ts: str, key: str, k: int | None = 100, where: Column | None = None) -> DataFrame:
    """Newest rows first; without a filter only the last k."""
    rows = df if where is None else df.filter(where)
    ordered = rows.orderBy(F.col(ts).desc(), F.col(key).desc())
    return ordered if where is not None or k is None else ordered.limit(k)


def oldest_unacked(events: DataFrame, acked: DataFrame, key: str, ts: str, n: int = 100) -> DataFrame:
    """The n oldest events that are not acknowledged."""
    return events.join(acked.select(key), key, "left_anti").orderBy(ts, key).limit(n)


def capped_queue(df: DataFrame, priority: str, order: list[str], capacity: dict[int, int] = QUEUE_CAPACITY) -> DataFrame:
    """Requests that fit the queue of their priority, served by priority and arrival.

    An unknown priority waits in queue 2.
    """
    known = F.when(F.col(priority).isin(list(capacity)), F.col(priority)).otherwise(F.lit(2))
    limit = F.create_map(*[F.lit(x) for kv in capacity.items() for x in kv])[F.col("queue")]
    most = max(capacity.values())
    rank = F.row_number().over(Window.partitionBy("queue").orderBy(*order))
    return (
        df.withColumn("queue", known).withColumn("place", rank).filter(F.col("place") <= most)
        .filter(F.col("place") <= limit).orderBy("queue", "place")
    )


def refused_requests(df: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    return df.join(accepted.select(key), key, "left_anti")


def node_score(model: Column, loaded: Column, used: Column, temperature_c: Column, slots: Column, workloads: Column) -> Column:
    """Fitness of a node for a workload: warm model, packing, heat, free slots."""
    return (
        F.when(F.array_contains(loaded, model), 50.0).otherwise(0.0)
        + used * 20.0
        - F.when(temperature_c > 75, (temperature_c - 75) * 2).otherwise(0.0)
        + (slots - workloads) * 5
    )


def best_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best node per request: requests (request_id, model), nodes (node_id, loaded, used, temperature_c, slots, workloads).

    Only the warm-model bonus depends on the request. So the best node overall
    and the best warm node per model are found once, and each request compares
    those two; requests never meet all nodes.
    """
    cold = (
        F.col("used") * 20.0 - F.when(F.col("temperature_c") > 75, (F.col("temperature_c") - 75) * 2).otherwise(0.0)
        + (F.col("slots") - F.col("workloads")) * 5
    )
    # Highest score, then lowest id.
    scored = nodes.withColumn("_cold", cold)
    place = F.struct(F.col("_cold"))
    per_score = lambda df, keys: df.groupBy(*keys, "_cold").agg(F.min("node_id").alias("node_id")).groupBy(*keys).agg(
        F.max_by("node_id", place).alias("node"), F.max("_cold").alias("score")
    )
    overall = per_score(scored, []).select(F.lit(1).alias("_one"), F.col("node").alias("_any"), F.col("score").alias("_any_score"))
    warm = per_score(scored.select("*", F.explode("loaded").alias("model")), ["model"]).select(
        "model", F.col("node").alias("_warm"), (F.col("score") + 50.0).alias("_warm_score")
    )
    both = requests.join(warm, "model", "left").withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one")
    # The overall best may itself be warm; its warm row then wins with the bonus.
    tie = (F.col("_warm_score") == F.col("_any_score")) & (F.col("_warm") < F.col("_any"))
    use_warm = F.coalesce((F.col("_warm_score") > F.col("_any_score")) | tie, F.lit(False))
    return both.select(
        *requests.columns, F.when(use_warm, F.col("_warm")).otherwise(F.col("_any")).alias("node_id"),
        F.when(use_warm, F.col("_warm_score")).otherwise(F.col("_any_score")).alias("score"),
    )


def alert_groups(df: DataFrame, by: list[str], order: list[str], most: int = 10) -> DataFrame:
    """Per group: how many alerts, and the first ones as an ordered list of at most ``most``."""
    ranked = ordered_scan(df, by, order, [row_number("_rn")])
    sent = F.when(F.col("_rn") <= most, F.struct(F.col("_rn").alias("n"), F.struct(*order).alias("alert")))
    listed = F.transform(F.array_sort(F.collect_list(sent)), lambda x: x["alert"])  # at most `most` entries
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("alerts"), listed.alias("sent"))


def point_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value)


def route_segments(segments: DataFrame, blocked: str | None, k: int = 5) -> DataFrame:
    """The first k segments of the corridor without the blocked one."""
    kept = segments if blocked is None else segments.filter(F.col("id") != blocked)
    return kept.orderBy("seg_order").limit(k)


def active_alerts(defects: DataFrame, advisories: DataFrame) -> DataFrame:
    """Defect alerts with their suppressed counts, together with the advisories."""
    return defects.unionByName(advisories, allowMissingColumns=True)


def missing_classes(expected: DataFrame, present: DataFrame, key: str = "class") -> DataFrame:
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def round_attendance(expected: DataFrame, submitted: DataFrame, least: int = 3) -> DataFrame:
    """Per round: clients that came, clients missing, and whether the round is aborted.

    Both sides are (round_id, client).
    """
    came = submitted.select("round_id", "client").distinct().withColumn("_came", F.lit(1))
    both = expected.select("round_id", "client").distinct().join(came, ["round_id", "client"], "left")
    return both.groupBy("round_id").agg(
        F.count_if(F.col("_came").isNotNull()).alias("submitted"), F.count_if(F.col("_came").isNull()).alias("absent")
    ).withColumn("aborted", F.col("submitted") < least)


def absent_clients(expected: DataFrame, submitted: DataFrame) -> DataFrame:
    keys = ["round_id", "client"]
    return expected.select(*keys).distinct().join(submitted.select(*keys), keys, "left_anti")


def first_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per id: the first in ``order``; later repeats are ignored."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")
