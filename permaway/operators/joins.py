"""Equi, range, nearest, interval and anti joins.

Point-to-range and nearest lookups never cross two tables: they run as an
ordered scan over the union of both sides, so every row is looked at once and
a crowded stretch of track is cut into chunks like any other hot key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.functions.scalars import one_per_key
from permaway.operators.fold import Jump, ordered_fold
from permaway.operators.scan import earlier_max, last_known, next_known, ordered_scan, row_number, running_max, running_min
from permaway.sources.corridor import CONFIG_FIELDS, TRAIN_CONFIGS


def station_edges(trains: DataFrame, stations: DataFrame) -> DataFrame:
    """Train to station by station id; trains without a station are left out."""
    placed = trains.filter((F.col("stationId").isNotNull()) & (F.col("stationId") != ""))
    return placed.join(stations.select(F.col("id").alias("stationId")), "stationId").select(
        F.col("trainId").alias("src"), F.col("stationId").alias("dst"), F.lit("occupies").alias("type")
    )


def segment_edges(stations: DataFrame, segments: DataFrame) -> DataFrame:
    """Station to each of its connected segments that exists."""
    linked = stations.select(F.col("id").alias("src"), F.explode("connected").alias("dst"))
    return linked.join(segments.select(F.col("id").alias("dst")), "dst").select(
        "src", "dst", F.lit("connects").alias("type")
    )


#: Of the dyadic intervals, those of so many upper levels are joined by broadcast: at most 2 to this power, less one.
UPPER_LEVELS = 12


def _cover(a: str, b: str) -> Column:
    """The dyadic intervals (level, node) that make up the whole numbers from ``a`` to before ``b``: at most two a level."""
    low, high = f"cast(ceil({a} / pow(2D, k)) AS bigint)", f"shiftright({b}, k)"
    pair = f"""array(
        if({low} < {high} AND {low} % 2 = 1, named_struct('level', k, 'node', {low}), NULL),
        if({low} < {high} AND {high} % 2 = 1, named_struct('level', k, 'node', {high} - 1), NULL))"""
    levels = f"sequence(0, cast(ceil(log2({b} + 1)) AS int))"
    return F.expr(f"filter(flatten(transform({levels}, k -> {pair})), x -> x IS NOT NULL)")


def first_open_ranges(ends: DataFrame) -> DataFrame:
    """``_hit``, the lowest order among the ranges that are open after each entry of ``ends`` (_at, _kind, _order), by ``_rank``.

    Entries are numbered in order. A range is open from its start's number to before its end's, which is a few dyadic
    intervals; each interval keeps the lowest order, and each entry looks at the intervals that it lies in, one a level.
    """
    numbered = ordered_scan(ends, [], ["_at", "_kind", "_order"], [row_number("_rank")])
    place = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_rank")))
    open_ = numbered.groupBy("_order").agg(place(0).alias("_a"), place(2).alias("_b")).filter("_a < _b")
    nodes = open_.select("_order", F.explode(_cover("_a", "_b")).alias("_n")).groupBy("_n.level", "_n.node").agg(F.min("_order").alias("_low"))
    top = max(ends.count(), 1).bit_length()
    cut = top - UPPER_LEVELS
    seen = numbered.select("_at", "_kind", "_rank", F.expr(f"explode(sequence(0, {top})) AS level")).withColumn("node", F.expr("shiftright(_rank, level)"))
    # Every entry lies in the few intervals of the upper levels, so those would be hot keys of a shuffle.
    lower = seen.filter(F.col("level") <= cut).join(nodes.filter(F.col("level") <= cut), ["level", "node"], "left")
    upper = seen.filter(F.col("level") > cut).join(F.broadcast(nodes.filter(F.col("level") > cut)), ["level", "node"], "left")
    return lower.unionByName(upper).groupBy("_at", "_kind", "_rank").agg(F.min("_low").alias("_hit"))


def range_lookup(
    points: DataFrame, ranges: DataFrame, *, at: str, order: str, start: str, end: str, keep: list[str],
    point_id: str,
) -> DataFrame:
    """Add the first range (by its unique integer ``order``) that holds each point, both ends included.

    A range that ends before it starts, or that lacks either, holds nothing.

    The ranges become a sorted list of starts and ends carrying the range that
    wins from there on; points take the entry before them in one ordered scan
    and fetch the range by an equi join. No point meets every range.
    """
    ends = ranges.select(
        F.col(order).cast("bigint").alias("_order"),
        F.explode(F.array(
            F.struct(F.col(start).cast("double").alias("_at"), F.lit(0).alias("_kind")),
            F.struct(F.col(end).cast("double").alias("_at"), F.lit(2).alias("_kind")),
        )).alias("_e"),
    ).select("_e.*", "_order")
    winners = first_open_ranges(ends.filter(F.col("_at").isNotNull() & ~F.isnan("_at")))
    # Order at one place: starts (0), points (1), ends (2).
    both = points.select(
        F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.col(point_id).cast("string").alias("_id"),
        F.lit(None).cast("struct<hit: bigint>").alias("_w"), F.struct("*").alias("_p"),
    ).unionByName(
        winners.select(
            "_at", "_kind", F.format_string("%020d", "_rank").alias("_id"), F.struct(F.col("_hit").alias("hit")).alias("_w"),
            F.lit(None).cast(points.schema).alias("_p"),
        )
    )
    seen = ordered_scan(both, [], ["_at", "_kind", "_id"], [last_known("_w", "_last")])
    placed = seen.filter(F.col("_p").isNotNull()).select("_p.*", F.col("_last.hit").alias("_hit"))
    named = ranges.select(
        F.col(order).cast("bigint").alias("_hit"),
        *[F.col(k).alias(k if k not in points.columns else f"range_{k}") for k in keep],
    )
    return placed.join(named, "_hit", "left").drop("_hit")


def nearest_lookup(
    points: DataFrame, places: DataFrame, *, at: str, place_at: str, place_id: str, point_id: str,
    within: float | None = None,
) -> DataFrame:
    """Add ``nearest`` and ``distance``: the place closest on the line; on a tie the one before.

    With ``within``, only points closer than that are kept.
    """
    both = points.select(
        F.col(at).cast("double").alias("_at"), F.struct("*").alias("_p"), F.lit(None).cast("string").alias("_place"),
        F.col(point_id).cast("string").alias("_id"), F.lit(1).alias("_kind"),
    ).unionByName(
        places.groupBy(F.col(place_at).cast("double").alias("_at")).agg(
            F.min(F.col(place_id).cast("string")).alias("_place")
        ).select(
            "_at", F.lit(None).cast(points.schema).alias("_p"), "_place", F.lit("").alias("_id"), F.lit(0).alias("_kind")
        )
    )
    mark = F.when(F.col("_place").isNotNull(), F.struct("_at", "_place"))
    seen = ordered_scan(
        both, [], ["_at", "_kind", "_id"], [last_known(mark, "_b"), next_known(mark, "_a")]
    ).filter(F.col("_p").isNotNull())
    before, after = F.col("_at") - F.col("_b._at"), F.col("_a._at") - F.col("_at")
    use_after = F.col("_b").isNull() | (after < before)
    out = seen.select(
        "_p.*",
        F.when(use_after, F.col("_a._place")).otherwise(F.col("_b._place")).alias("nearest"),
        F.when(use_after, after).otherwise(before).alias("distance"),
    )
    return out if within is None else out.filter(F.col("distance") < within)


def signal_aspects(signals: DataFrame, trains: DataFrame, *, signal: str, km: str) -> DataFrame:
    """Add ``aspect``: red under 2 km to the nearest train, yellow under 5, else green."""
    seen = nearest_lookup(
        signals, trains.select("km").distinct(), at=km, place_at="km", place_id="km", point_id=signal
    )
    d = F.col("distance")
    return seen.withColumn("aspect", F.when(d < 2, "red").when(d < 5, "yellow").otherwise("green")).drop("nearest")


def defect_marks(
    segments: DataFrame, defects: DataFrame, *, segment: str = "id", mode: str = "touch"
) -> DataFrame:
    """Add ``has_defect`` to segments (start_km, end_km) by defects (start_km, end_km).

    ``touch``: an end of a defect lies inside the segment. ``overlap``: the
    two share any place, also when the defect spans the whole segment.
    """
    segs = segments.select(
        F.struct("*").alias("_s"), F.col("start_km").alias("_lo"), F.col("end_km").alias("_hi"),
        F.col(segment).cast("string").alias("_id"),
    )
    empty = F.lit(None).cast(segs.schema["_s"].dataType)
    none = F.lit(None).cast("double")
    if mode == "touch":
        ends = defects.select(F.explode(F.array("start_km", "end_km")).alias("_at")).distinct()
        both = segs.select("_s", "_hi", F.col("_lo").alias("_at"), none.alias("_d"), "_id", F.lit(0).alias("_kind")).unionByName(
            ends.select(
                empty.alias("_s"), none.alias("_hi"), "_at", F.col("_at").alias("_d"), F.lit("").alias("_id"), F.lit(1).alias("_kind")
            )
        )
        seen = ordered_scan(both, [], ["_at", "_kind", "_id"], [next_known("_d", "_next")])
        hit = F.col("_next") <= F.col("_hi")
    elif mode == "overlap":
        spans = defects.groupBy(F.col("start_km").alias("_at")).agg(F.max("end_km").alias("_d"))
        both = segs.select("_s", "_lo", F.col("_hi").alias("_at"), none.alias("_d"), "_id", F.lit(1).alias("_kind")).unionByName(
            spans.select(empty.alias("_s"), none.alias("_lo"), "_at", "_d", F.lit("").alias("_id"), F.lit(0).alias("_kind"))
        )
        seen = ordered_scan(both, [], ["_at", "_kind", "_id"], [running_max("_d", "_reach")])
        hit = F.col("_reach") >= F.col("_lo")
    else:
        raise ValueError(mode)
    return seen.filter(F.col("_s").isNotNull()).select(
        "_s.*", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0).alias("has_defect")
    )


def zone_of(df: DataFrame, zones: DataFrame, place: str, kind: str = "stations") -> DataFrame:
    """Add ``zone`` of a station or segment id; unknown places keep null."""
    named = one_per_key(zones.select(F.explode(kind).alias(place), "zone"), [place])
    return df.join(named, place, "left")


def slot_conflicts(
    slots: DataFrame, keys: list[str], *, enter: str = "enterAt", leave: str = "exitAt", slot: str = "slot_id",
    train: str = "trainId", same_train: bool = True,
) -> DataFrame:
    """Add ``conflict``: the slot overlaps an earlier-entering slot on the same key.

    Two slots overlap when ``max(enter) < min(exit)``. Only flags are made,
    never the pairs: a slot overlaps an earlier one exactly when the latest
    exit so far is after its entry. With ``same_train=False`` slots of the
    same train do not count, which needs the latest exit of another train;
    ``slot`` must then be unique over the whole frame.
    """
    usable = slots.filter(F.col(enter).isNotNull() & F.col(leave).isNotNull())
    if same_train:
        order = [enter, slot]
        # An empty or reversed window can overlap nothing.
        until = F.when(F.col(enter) < F.col(leave), F.col(leave))
        seen = ordered_scan(usable, keys, order, [earlier_max(until, "_before")])
        hit = (F.col(enter) < F.col(leave)) & (F.col("_before") > F.col(enter))
        return seen.withColumn("conflict", F.coalesce(hit, F.lit(False))).drop("_before")
    spans = usable.select(
        *keys, slot, F.col(train).cast("string").alias("_train"),
        F.unix_micros(F.col(enter).cast("timestamp")).alias("_enter"), F.unix_micros(F.col(leave).cast("timestamp")).alias("_exit"),
    )
    kind = spans.schema[slot].dataType.simpleString()
    flags = ordered_fold(
        spans, keys, ["_enter", slot], _rival_conflicts(slot), f"{slot} {kind}, conflict boolean",
        jump=Jump(lambda _, reached: reached, lambda own, before: _latest_two(own + before), []),
    )
    return usable.join(flags, slot)


def _latest_two(exits: list) -> list:
    """The latest exit of each of the two trains that leave last."""
    best: dict[str, int] = {}
    for until, who in exits:
        best[who] = max(until, best.get(who, until))
    return sorted(([until, who] for who, until in best.items()), reverse=True)[:2]


def _rival_conflicts(slot: str):
    """Step that flags a slot entered before another train has left."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        latest = state or []
        flags = []
        for who, enter, leave in zip(pdf["_train"], pdf["_enter"].tolist(), pdf["_exit"].tolist()):
            flags.append(enter < leave and any(until > enter for until, name in latest if name != who))
            if enter < leave:
                latest = _latest_two(latest + [[leave, who]])
        return pd.DataFrame({slot: pdf[slot].to_numpy(), "conflict": flags}), latest

    return step


def conflict_free(slots: DataFrame, proposal: str = "proposalId", segment: str = "segmentId", **options) -> DataFrame:
    """One row per proposal: whether no two slots on a segment overlap."""
    flagged = slot_conflicts(slots, [proposal, segment], **options)
    return flagged.groupBy(proposal).agg((F.count_if("conflict") == 0).alias("conflict_free"))


def geometry_lookup(df: DataFrame, geometry: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add track ``gradient`` and ``curve_radius`` by coordinates rounded to 4 places; 0 when unknown."""
    keyed = one_per_key(geometry.select(
        F.round("lat", 4).alias("_glat"), F.round("lon", 4).alias("_glon"), "gradient", "curve_radius"
    ), ["_glat", "_glon"])
    here = df.withColumns({"_glat": F.round(lat, 4), "_glon": F.round(lon, 4)})
    out = here.join(keyed, ["_glat", "_glon"], "left").drop("_glat", "_glon")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("gradient", "curve_radius")})


def undecided(advisories: DataFrame, decisions: DataFrame, key: str = "advisory_id") -> DataFrame:
    """Advisories without any authorisation or rejection."""
    done = decisions.filter(F.col("action").isin("AUTHORIZE", "REJECT")).select(key).distinct()
    return advisories.join(done, key, "left_anti")


# Days to keep by category (fixed values); no entry means without end.
RETENTION_DAYS = {
    "raw_sensor_events": 90,
    "inference_audit_logs": 365,
    "security_anomaly": 365,
    "forensic_evidence": 365,
    "telemetry_metrics": 30,
    "authorization_events": 365,
}


def retention_days(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RETENTION_DAYS.items() for x in kv])[category]


def retention_due(
    rows: DataFrame, holds: DataFrame, as_of: Column, *, ts: str = "ts", row_id: str = "row_id"
) -> DataFrame:
    """Rows past their time to live that no active hold covers, by alert id or by time range.

    The time test is a scan: a row is covered when the furthest end among the
    holds that started by then is not before it.
    """
    expired = rows.filter(F.col(ts) < as_of - F.make_interval(days=retention_days(F.col("category"))))
    active = holds.filter("active")
    by_id = active.filter(F.col("alert_id").isNotNull()).select("alert_id").distinct()
    free = expired.join(by_id, "alert_id", "left_anti")
    spans = active.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy("start").agg(F.max("end").alias("end"))
    both = free.select(
        F.col(ts).alias("_at"), F.struct("*").alias("_row"), F.lit(None).cast("timestamp").alias("_end"),
        F.col(row_id).cast("string").alias("_id"), F.lit(1).alias("_kind"),
    ).unionByName(
        spans.select(
            F.col("start").alias("_at"), F.lit(None).cast(rows.schema).alias("_row"), F.col("end").alias("_end"),
            F.lit("").alias("_id"), F.lit(0).alias("_kind"),
        )
    )
    seen = ordered_scan(both, [], ["_at", "_kind", "_id"], [running_max("_end", "_held")])
    kept = F.col("_held").isNull() | (F.col("_held") < F.col("_at"))
    return seen.filter(F.col("_row").isNotNull() & kept).select("_row.*")


def detection_rate(
    patterns: DataFrame, anomalies: DataFrame, *, seconds: int = 60, least: float = 0.80
) -> DataFrame:
    """Share of injected patterns (pattern_id, ts) followed by an anomaly (ts) within the window."""
    none = F.lit(None).cast("timestamp")
    both = patterns.select(
        F.col("ts").alias("_at"), F.col("pattern_id").cast("string").alias("_id"), none.alias("_seen"), F.lit(0).alias("_kind")
    ).unionByName(
        anomalies.select("ts").distinct().select(
            F.col("ts").alias("_at"), F.lit("").alias("_id"), F.col("ts").alias("_seen"), F.lit(1).alias("_kind")
        )
    )
    seen = ordered_scan(both, [], ["_at", "_kind", "_id"], [next_known("_seen", "_next")])
    hit = F.col("_next") <= F.col("_at") + F.make_interval(secs=F.lit(seconds))
    return (
        seen.filter(F.col("_kind") == 0)
        .agg(
            F.count(F.lit(1)).alias("injected"),
            F.count_if(F.coalesce(hit, F.lit(False))).alias("detected"),
        )
        .withColumn("detection_rate", F.coalesce(F.round(F.col("detected") / F.nullif(F.col("injected"), F.lit(0)), 3), F.lit(0.0)))
        .withColumn("passed", F.col("detection_rate") >= least)
    )


def as_of_join(
    left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], *, row_id: str
) -> DataFrame:
    """Add the last right-hand ``values`` at or before each left row of the same key."""
    hold = F.struct(*values)
    both = left.select(
        F.col(key).alias("_k"), F.col(ts).alias("_at"), F.struct("*").alias("_l"),
        F.lit(None).cast(right.select(*values).schema).alias("_r"), F.col(row_id).cast("string").alias("_id"),
        F.lit(1).alias("_kind"),
    ).unionByName(
        right.groupBy(F.col(key).alias("_k"), F.col(ts).alias("_at")).agg(F.max(hold).alias("_r")).select(
            "_k", "_at", F.lit(None).cast(left.schema).alias("_l"), "_r", F.lit("").alias("_id"), F.lit(0).alias("_kind")
        )
    )
    seen = ordered_scan(both, ["_k"], ["_at", "_kind", "_id"], [last_known("_r", "_v")])
    return seen.filter(F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_v.{v}").alias(f"right_{v}") for v in values])


def position_error(simulated: DataFrame, recorded: DataFrame, *, row_id: str) -> DataFrame:
    """Mean absolute difference between simulated and last recorded position (train, ts, km), in metres."""
    paired = as_of_join(simulated, recorded, "train", "ts", ["km"], row_id=row_id)
    err = F.avg(F.abs(F.col("km") - F.col("right_km")) * 1000)
    return paired.agg(F.count("right_km").alias("steps"), err.alias("mae_m")).withColumn("passed", F.col("mae_m") <= 500)


# Controller roles: tiers each may decide (fixed values).
ROLE_TIERS = {"SENIOR_OC": [1, 2, 3], "OC": [2, 3], "SUPERVISOR": [3]}


def gate_decisions(requests: DataFrame, controllers: DataFrame, order: list[str]) -> DataFrame:
    """Requests with the ``status`` that the gate answers, in the order of each advisory.

    Requests hold advisory_id, risk_tier, controller and action; ``order`` is unique within an advisory. Controllers
    (controller, role) decide which tiers may be authorised; an unknown one counts as OC. A tier-1 advisory needs two
    different controllers. The first decision closes an advisory; requests after it find nothing.
    """
    named = requests.join(one_per_key(controllers.select("controller", "role"), ["controller"]), "controller", "left")
    role = F.coalesce("role", F.lit("OC"))
    tiers = F.coalesce(
        F.create_map(*[x for r, t in ROLE_TIERS.items() for x in (F.lit(r), F.array(*[F.lit(i) for i in t]))])[role],
        F.array(*[F.lit(i) for i in ROLE_TIERS["OC"]]),
    )
    action, dual = F.upper(F.col("action")), F.col("risk_tier") == 1
    allowed = F.array_contains(tiers, F.col("risk_tier").cast("int"))
    place = F.struct(*order, "controller")
    first = F.when(allowed & (action == "AUTHORIZE"), place)
    seconds = F.col("_first.controller") != F.col("controller")
    decides = allowed & ((action == "REJECT") | ((action == "AUTHORIZE") & (~dual | seconds)))
    seen = ordered_scan(
        named, ["advisory_id"], order, [running_min(first, "_first")], [earlier_max(F.coalesce(decides, F.lit(False)).cast("int"), "_closed")]
    )
    status = (
        F.when(F.col("_closed") == 1, "NOT_FOUND")
        .when(~allowed, "REFUSED_ROLE")
        .when(action == "REJECT", "REJECTED")
        .when(F.coalesce(action != "AUTHORIZE", F.lit(True)), "INVALID_ACTION")
        .when(~dual | seconds, "AUTHORIZED")
        .when(F.col("_first") == place, "AWAITING_SECOND_AUTH")
        .otherwise("REFUSED_SAME_CONTROLLER")
    )
    return seen.withColumn("status", status).drop("_first", "_closed", "role")


def train_config(train_type: Column) -> Column:
    """Configuration struct of a train type; an unknown type takes the default.

    The configurations are a fixed list, so this is a map lookup and no join.
    """
    rows = {r[0]: F.struct(*[F.lit(v).alias(n) for n, v in zip(CONFIG_FIELDS, r[1:])]) for r in TRAIN_CONFIGS}
    table = F.create_map(*[x for name, row in rows.items() for x in (F.lit(name), row)])
    return F.coalesce(table[train_type], rows["default"])


def uninhibited(alerts: DataFrame) -> DataFrame:
    """Alerts without the warnings of a component that also has a critical alert."""
    critical = alerts.filter(F.col("severity") == "critical").select("component").distinct()
    warned = alerts.filter(F.col("severity") == "warning").join(critical, "component", "left_anti")
    return alerts.filter(F.coalesce(F.col("severity") != "warning", F.lit(True))).unionByName(warned)


def series_and(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def series_or(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.unionByName(right.join(left.select(*on).distinct(), on, "left_anti"))


def series_absent(df: DataFrame, metric: str) -> DataFrame:
    """One row when no sample of the metric exists, none otherwise."""
    return (
        df.filter(F.col("metric") == metric).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
        .select(F.lit(metric).alias("metric"), F.lit(1.0).alias("value"))
    )


def deployed_baseline(runs: DataFrame, candidate: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidate metrics beside the latest deployed ones; the registry fills models without a run.

    ``runs`` (model_id, deployed, start_time, metrics MAP), ``candidate`` and
    ``registry`` (model_id, metric, value).
    """
    latest = runs.filter("deployed").groupBy("model_id").agg(F.max_by("metrics", "start_time").alias("metrics"))
    live = latest.select("model_id", F.explode("metrics").alias("metric", "value"))
    fallback = registry.join(latest.select("model_id"), "model_id", "left_anti")
    base = live.unionByName(fallback.select("model_id", "metric", "value"))
    return base.withColumnRenamed("value", "deployed").join(
        candidate.withColumnRenamed("value", "candidate"), ["model_id", "metric"], "full"
    )


def lineage(inferences: DataFrame, advisories: DataFrame, authorizations: DataFrame, hazards: DataFrame) -> DataFrame:
    """Inference to advisory to authorisation to hazard, one row per inference and its links."""
    return (
        inferences.join(advisories, "inference_id", "left")
        .join(authorizations, "advisory_id", "left")
        .join(hazards.withColumnRenamed("linked_advisory_id", "advisory_id"), "advisory_id", "left")
    )


def dataset_links(models: DataFrame, versions: DataFrame) -> DataFrame:
    """Models with the registered names of their training and evaluation datasets."""
    def side(prefix: str) -> DataFrame:
        return versions.select(
            F.col("dataset_version_id").alias(f"{prefix}_version_id"), F.col("dataset_name").alias(f"{prefix}_name")
        )

    return models.join(side("training"), "training_version_id", "left").join(side("eval"), "eval_version_id", "left")


def acknowledged(anomalies: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Anomalies with the officer and time of their latest acknowledgement; open ones keep nulls."""
    latest = acknowledgements.groupBy("alert_id").agg(
        F.max_by("officer", "acknowledged_at").alias("officer"), F.max("acknowledged_at").alias("acknowledged_at")
    )
    return anomalies.join(latest, "alert_id", "left").withColumn("open", F.col("acknowledged_at").isNull())


def rollout_targets(deployments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Model, node_id and healthy_nodes: one row for each listed node; a deployment without a list goes to every alive
    and healthy node and is one row with their number."""
    healthy = nodes.filter("alive AND health = 'HEALTHY'").agg(F.count(F.lit(1)).alias("healthy_nodes"))
    listed = deployments.filter(F.size("targets") > 0).select("model", F.explode("targets").alias("node_id"), F.lit(None).cast("bigint").alias("healthy_nodes"))
    open_ = deployments.filter(F.coalesce(F.size("targets"), F.lit(0)) <= 0).select(
        "model", F.lit(None).cast("bigint").alias("node_id"), healthy.scalar().alias("healthy_nodes")
    )
    return listed.unionByName(open_)
