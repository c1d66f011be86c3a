"""Row-wise predicates, splits and gates. All stay inside one projection or filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.functions.risk import failure_interval, risk_score, risk_tier
from permaway.schemas import SENSOR_TYPES

FEATURES = [
    "vibration_rms", "vibration_kurtosis", "vibration_peak", "temperature_bogie",
    "wheel_load_left", "wheel_load_right", "acoustic_emission_rms", "speed_kmh",
]
# Payload key -> feature, as the window extractor names them (fixed values).
BOGIE_KEYS = {
    "bearing_rms_g": "vibration_rms", "bearing_kurtosis": "vibration_kurtosis", "bearing_peak_g": "vibration_peak",
    "bogie_temp_c": "temperature_bogie", "acoustic_rms": "acoustic_emission_rms", "speed_kmh": "speed_kmh",
}
AXLE_KEYS = {"wheel_load_left_kn": "wheel_load_left", "wheel_load_right_kn": "wheel_load_right", "speed_kmh": "speed_kmh"}
# Payload key -> feature, as the feed parsers of this library emit them.
FEED_KEYS = {name: name for name in FEATURES}

HORIZON_HOURS = 72


def feature_vector(payload: Column, keys: dict[str, str]) -> Column:
    """Eight features from a string map; a missing key gives 0."""
    source = {feature: key for key, feature in keys.items()}
    return F.array(
        *[
            F.coalesce(payload[source[f]].try_cast("float"), F.lit(0.0).cast("float"))
            if f in source else F.lit(0.0).cast("float")
            for f in FEATURES
        ]
    )


def advisory_split(
    df: DataFrame,
    *,
    probability: str = "p",
    interpolation_pct: str = "interpolation_pct",
    quantile: float = 0.15,
    base_width: float | None = None,
    max_pct: float = 40.0,
    threshold: float = 0.80,
) -> DataFrame:
    """Advisories from scored windows: poor data, nothing, or an advisory with interval and risk."""
    pct = F.col(interpolation_pct)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(probability)))
    kind = F.when(pct > max_pct, "INSUFFICIENT_DATA").when(p > threshold, "MAINTENANCE_ADVISORY")
    scored = df.withColumn("alert_type", kind).filter(F.col("alert_type").isNotNull())
    advised = F.col("alert_type") == "MAINTENANCE_ADVISORY"
    interval = failure_interval(p, pct, quantile, base_width)
    return scored.withColumns(
        {
            "failure_probability": F.when(advised, F.round(p, 4)),
            "ci_lower": F.when(advised, interval["lower"]),
            "ci_upper": F.when(advised, interval["upper"]),
            "horizon_hours": F.when(advised, F.lit(HORIZON_HOURS)),
            "data_quality_pct": F.round(pct, 2),
            "risk_score": F.when(advised, F.round(risk_score(p), 4)),
            "risk_tier": F.when(advised, risk_tier(risk_score(p))),
        }
    )


def inference_requests(df: DataFrame, rms: str = "rms", kurtosis: str = "kurtosis") -> DataFrame:
    """Windows that call for inference, with priority and deadline."""
    urgent = F.col(rms) > 4.0
    return df.filter((F.col(rms) > 2.0) | (F.abs(F.col(kurtosis)) > 4.0)).withColumns(
        {
            "priority": F.when(urgent, "HIGH").otherwise("NORMAL"),
            "deadline_ms": F.when(urgent, 100).otherwise(500),
        }
    )


def admission_status(age_ms: Column, deadline_ms: Column, priority: Column, throttled: Column) -> Column:
    """``deadline_miss``, ``throttled`` or ``accepted``; under throttle only priorities 0 and 1 pass."""
    return (
        F.when(age_ms > deadline_ms, "deadline_miss")
        .when(throttled & (priority > 1), "throttled")
        .otherwise("accepted")
    )


def utilization(cpu_pct: Column, gpu_pct: Column, ram_pct: Column) -> Column:
    return (cpu_pct + gpu_pct * 2 + ram_pct) / 400.0


def can_accept(available: Column, workloads: Column, limit: Column, gpu_pct: Column, temperature_c: Column) -> Column:
    return available & (workloads < limit) & (gpu_pct < 95.0) & (temperature_c < 85.0)


def sla_violations(
    df: DataFrame, key: str = "station", max_queue: int = 1000, max_temperature: float = 85.0
) -> DataFrame:
    """One row per broken limit: queue depth, temperature, overload."""
    def entry(metric: str, value: Column, limit: str, broken: Column) -> Column:
        row = F.struct(
            F.lit(metric).alias("metric"), value.cast("string").alias("value"), F.lit(limit).alias("threshold")
        )
        return F.when(broken, row)

    broken = F.array_compact(
        F.array(
            entry("queue_depth", F.col("queue_depth"), str(max_queue), F.col("queue_depth") > max_queue),
            entry("temperature", F.col("temperature_c"), str(max_temperature), F.col("temperature_c") > max_temperature),
            entry("health", F.col("health"), "HEALTHY", F.col("health") == "OVERLOADED"),
        )
    )
    return df.select(key, F.explode(broken).alias("_v")).select(key, "_v.*")


def privilege_alerts(df: DataFrame) -> DataFrame:
    """Security alerts kept by rule name or priority, fields from the map or the alert text.

    Input: ``rule``, ``priority``, ``output`` and the map ``output_fields``.
    """
    def field(key: str, prefix: str) -> Column:
        from_text = F.regexp_extract("output", prefix + r"=([^ ]*)", 1)
        return F.coalesce(
            F.nullif(F.col("output_fields")[key], F.lit("")), F.nullif(from_text, F.lit("")), F.lit("unknown")
        )

    kept = F.upper("rule").contains("PRIVILEGE_ESCALATION") | (F.upper("priority") == "CRITICAL")
    return df.filter(kept).withColumns(
        {
            "container_name": field("container.name", "container"),
            "pod_name": field("k8s.pod.name", "pod"),
            "capability": field("syscall.type", "syscall"),
        }
    )


# Processes, containers and remotes of the runtime rules.
CONTAINER_RUNTIMES = ["runc", "containerd"]
IDENTITY_DAEMONS = ["runc", "containerd", "dockerd"]
FILE_DAEMONS = ["runc", "containerd", "fluentd"]
WATCHED_CONTAINERS = ["defect-detector", "maintenance-engine", "delay-predictor"]
KNOWN_REMOTES = ["kafka-bootstrap", "influxdb-primary", "mlflow"]


def runtime_rules(namespace: str) -> list[tuple[str, str, Column]]:
    """The four syscall rules as (name, priority, predicate) over flat event columns."""
    inside = F.col("namespace") == namespace
    contained = F.col("container") != "host"
    proc_not = lambda *names: ~F.col("proc").isin(*names)
    return [
        (
            "privilege_escalation", "CRITICAL",
            F.col("syscall").isin("setuid", "setgid") & contained & proc_not(*IDENTITY_DAEMONS) & inside,
        ),
        (
            "capability_addition", "CRITICAL",
            (F.col("syscall") == "capset") & contained & inside & proc_not(*CONTAINER_RUNTIMES),
        ),
        (
            "read_only_filesystem", "WARNING",
            F.col("operation").isin("open_write", "rename", "mkdir")
            & (F.col("path").startswith("/etc") | F.col("path").startswith("/proc"))
            & contained & inside & proc_not(*FILE_DAEMONS),
        ),
        (
            "outbound_connection", "WARNING",
            (F.col("operation") == "connect") & inside
            & F.col("container").isin(*WATCHED_CONTAINERS)
            & ~F.col("remote").isin(*KNOWN_REMOTES),
        ),
    ]


def match_runtime_rules(df: DataFrame, namespace: str) -> DataFrame:
    """One row per event and rule it breaks."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(p).alias("rule_priority")))
                for n, p, hit in runtime_rules(namespace)
            ]
        )
    )
    return df.withColumn("_hit", F.explode(hits)).select(*df.columns, "_hit.*")


def regression_gate(df: DataFrame, tolerance: float = 0.05, direction: str | None = None) -> DataFrame:
    """Add ``degradation``, ``degradation_pct`` and ``passed`` to (deployed, candidate) rows.

    ``direction`` names a column holding ``higher`` or ``lower``; by default
    every metric counts as higher-is-better.
    """
    dep, cand = F.col("deployed"), F.col("candidate")
    worse = (dep - cand) / F.abs(dep)
    if direction is not None:
        worse = F.when(F.col(direction) == "lower", -worse).otherwise(worse)
    return df.withColumns(
        {
            "degradation": F.when(dep != 0, worse).otherwise(0.0),
            "degradation_pct": F.round(F.abs(cand - dep) / F.greatest(F.abs(dep), F.lit(1e-9)) * 100, 2),
            "passed": (dep == 0) | (worse <= tolerance),
        }
    )


def snapshot_defaults(df: DataFrame) -> DataFrame:
    """Train snapshot with the defaults of a forecast filled in."""
    return df.na.fill({"current_delay_min": 0.0, "load_factor": 0.5, "schedule_adherence": 1.0})


def reading_quality(sensor_type: Column, sequence: Column, interpolation_pct: Column) -> Column:
    checks = [sensor_type.isin(SENSOR_TYPES), sequence >= 0, interpolation_pct.between(0, 100)]
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def buffer_capacity(df: DataFrame, node: str = "node_id", max_rows: int = 864_000) -> DataFrame:
    """Fill of each node's buffer in percent, and whether it is over 90."""
    pct = F.least(F.lit(100.0), F.count_if(~F.col("acked")) / max_rows * 100.0)
    return df.groupBy(node).agg(pct.alias("capacity_pct")).withColumn("over", F.col("capacity_pct") >= 90.0)


def require_float_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Refuse a frame whose parameter columns are not float arrays."""
    for name in columns:
        kind = df.schema[name].dataType.simpleString()
        if kind not in ("array<float>", "array<double>"):
            raise TypeError(f"{name} is {kind}, expected an array of floats")
    return df


def gauge_alerts(df: DataFrame, metric: str, limit: float) -> DataFrame:
    """Samples ``(metric, labels, ts, value)`` of a gauge above its limit."""
    return df.filter((F.col("metric") == metric) & (F.col("value") > limit))


def ratio_alerts(df: DataFrame, numerator: str, denominator: str, limit: float) -> DataFrame:
    """Ratio of two gauges with equal labels and time, above its limit.

    Both sides are reduced to one row per label set and time in one
    aggregation, so there is no self join.
    """
    labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    both = (
        df.filter(F.col("metric").isin(numerator, denominator))
        .groupBy(labels.alias("labels"), "ts")
        .agg(pick(numerator).alias("_n"), pick(denominator).alias("_d"))
    )
    return both.select("labels", "ts", (F.col("_n") / F.nullif(F.col("_d"), F.lit(0.0))).alias("ratio")).filter(
        F.col("ratio") > limit
    )


def defect_alerts(df: DataFrame, confidence: str = "confidence", above: float = 0.8) -> DataFrame:
    return df.filter(F.col(confidence) > above).withColumn("alert_type", F.lit("ML_DEFECT_DETECTED"))


def node_health(queue_depth: Column) -> Column:
    return F.when(queue_depth > 5000, "OVERLOADED").when(queue_depth > 1000, "DEGRADED").otherwise("HEALTHY")


# Access rules in order, first match wins (fixed values): method, path, roles.
_OC, _SO, _ET, _GO = "Operations_Controller", "Security_Officer", "Engineering_Team", "Governance_Officer"
ACCESS_RULES = [
    ("*", r"^/api/v\d+/advisories(/.*)?$", [_OC]),
    ("*", r"^/api/v\d+/scheduler(/.*)?$", [_OC]),
    ("GET", r"^/api/v\d+/digital-twin(/.*)?$", [_OC, _ET]),
    ("POST", r"^/api/v\d+/anomalies/[^/]+/acknowledge$", [_SO]),
    ("GET", r"^/api/v\d+/forensics(/.*)?$", [_SO]),
    ("*", r"^/api/v\d+/security(/.*)?$", [_SO]),
    ("POST", r"^/api/v\d+/models/[^/]+/rollback$", [_ET]),
    ("POST", r"^/api/v\d+/models(/.*)?$", [_ET]),
    ("PUT", r"^/api/v\d+/models(/.*)?$", [_ET]),
    ("*", r"^/api/v\d+/mlflow(/.*)?$", [_ET]),
    ("GET", r"^/api/v\d+/governance/lineage(/.*)?$", [_GO]),
    ("*", r"^/api/v\d+/retention(/.*)?$", [_GO]),
    ("*", r"^/api/v\d+/retention/holds(/.*)?$", [_SO, _GO]),
    ("GET", r"^/api/v\d+/audit(/.*)?$", [_SO, _ET, _GO]),
    ("GET", r"^/api/v\d+/traceability(/.*)?$", [_ET, _SO]),
    ("GET", r"^/api/v\d+/delay-predictor(/.*)?$", [_OC, _ET]),
    ("POST", r"^/api/v\d+/delay-predictor(/.*)?$", [_OC, _ET]),
    ("GET", r"^/api/v\d+/maintenance(/.*)?$", [_OC, _ET]),
    ("GET", r"^/api/v\d+/defect-detector(/.*)?$", [_OC, _ET]),
]


def access_decision(df: DataFrame, rules: list[tuple[str, str, list[str]]] = ACCESS_RULES) -> DataFrame:
    """Add ``required``, ``granted`` and ``permitted`` to requests (roles, method, path); no rule means deny.

    The rules are a fixed list, so the first match is one CASE expression and no join.
    """
    required = F.lit(None).cast("array<string>")
    for method, pattern, roles in reversed(rules):
        hit = F.col("path").rlike(pattern)
        if method != "*":
            hit = hit & (F.upper("method") == method)
        required = F.when(hit, F.array(*[F.lit(r) for r in roles])).otherwise(required)
    return (
        df.withColumn("required", required)
        .withColumn("granted", F.array_sort(F.array_intersect("roles", "required")))
        .withColumn("permitted", F.coalesce(F.size("granted") > 0, F.lit(False)))
    )
