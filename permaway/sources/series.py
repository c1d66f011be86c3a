"""Time-series points, write retries, log index rows and metric scans."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_DELAYS = (1.0, 2.0)

# Tag of a log row by the start of its topic, first match wins (fixed values).
LOG_TAGS = [
    ("^monitoring\\.alerts", "system_alert"),
    ("^audit\\.", "audit"),
    ("^security\\.", "security"),
    ("^dead-letter\\.", "dead_letter"),
]


def to_points(df: DataFrame, value: str = "value", topic: str = "topic") -> DataFrame:
    """Canonical event texts as points: measurement, tags, numeric and text fields, time."""
    top = "struct<sensorType: string, assetId: string, sourceId: string, zone: string, timestamp_utc: string, payload: map<string,variant>>"
    number_type = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"
    # The message is opened once, and the type of every payload entry is looked up once.
    opened = (
        # Through an explode of one entry the filter stays here and the parse is not repeated for it.
        df.select("*", F.explode(F.array(F.try_parse_json(F.col(value)))).alias("_event"))
        .filter(F.col("_event").isNotNull())
        .withColumn("_top", F.try_variant_get("_event", "$", top))
        .withColumn("_entries", F.transform(
            F.map_entries("_top.payload"),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("type")),
        ))
    )
    entries = F.col("_entries")
    text = lambda path, default: F.coalesce(F.col(f"_top.{path}"), F.lit(default))
    numbers = F.filter(entries, lambda e: e["type"].rlike(number_type))
    others = F.filter(entries, lambda e: ~e["type"].rlike(number_type) & (e["type"] != "VOID"))
    read = lambda kind: lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", kind).alias("value"))
    return opened.select(
        text("sensorType", "unknown").alias("measurement"),
        F.create_map(
            F.lit("asset_id"), text("assetId", "unknown"), F.lit("source_id"), text("sourceId", "unknown"),
            F.lit("zone"), text("zone", "unknown"), F.lit("topic"), F.col(topic),
        ).alias("tags"),
        F.map_from_entries(F.transform(numbers, read("double"))).alias("numbers"),
        F.map_from_entries(F.transform(others, read("string"))).alias("texts"),
        text("timestamp_utc", "").alias("time"),
    )


def points_long(points: DataFrame) -> DataFrame:
    """One row per numeric field."""
    long = points.select("measurement", "tags", "time", F.explode_outer("numbers").alias("field", "value"))
    return long.filter(F.col("field").isNotNull())


def write_with_retry(
    df: DataFrame,
    write: Callable[[DataFrame], None],
    failed_path: str,
    alert_path: str,
    *,
    event_id: str = "event_id",
    topic: str | None = None,
    delays: tuple[float, ...] = RETRY_DELAYS,
) -> bool:
    """Write a batch in up to three attempts; then keep it in the failure table and raise an alert row.

    Usable as the body of ``foreachBatch``. Nothing is dropped. ``topic`` names where the rows came from; without it a column of that name does.
    """
    for attempt in range(len(delays) + 1):
        try:
            write(df)
            return True
        except Exception as error:
            if attempt < len(delays):
                time.sleep(delays[attempt])
            else:
                reason = str(error)
    kept = df.select(
        F.coalesce(F.col(event_id).cast("string"), F.lit("unknown")).alias("event_id"),
        F.to_json(F.struct(*df.columns)).alias("payload_json"),
        F.current_timestamp().alias("failed_at"),
        (F.col("topic").cast("string") if topic is None and "topic" in df.columns else F.lit(topic).cast("string")).alias("topic"),
    )
    kept.write.mode("append").parquet(failed_path)
    alert = df.agg(F.count(F.lit(1)).alias("events")).select(
        F.lit("STORAGE_WRITE_FAILURE").alias("alertType"), "events", F.lit(reason).alias("reason"),
        F.current_timestamp().alias("ts"),
    )
    alert.write.mode("append").parquet(alert_path)
    return False


def failure_depth(failed: DataFrame) -> DataFrame:
    """How many events the failure table holds, by topic, and since when."""
    return failed.groupBy("topic").agg(F.count(F.lit(1)).alias("depth"), F.min("failed_at").alias("oldest"))


def write_epoch(df: DataFrame, epoch: int, path: str, partition_by: list[str]) -> None:
    """``foreachBatch`` body that may run again: each epoch owns one folder and overwrites it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/epoch={epoch}")


def log_rows(df: DataFrame, value: str = "value", topic: str = "topic", ingest: str = "ts") -> DataFrame:
    """Log messages with event time, tag and daily index name; unreadable JSON keeps its ingest time."""
    event = F.try_parse_json(F.col(value))
    tag = F.lit(None).cast("string")
    for pattern, name in reversed(LOG_TAGS):
        tag = F.when(F.col(topic).rlike(pattern), F.lit(name)).otherwise(tag)
    at = F.coalesce(F.try_to_timestamp(F.try_variant_get(event, "$.timestamp_utc", "string")), F.col(ingest).cast("timestamp"))
    out = df.select(
        F.col(topic).alias("kafka_topic"), at.alias("at"), tag.alias("tag"),
        event.isNotNull().alias("parsed"), F.col(value).alias("event"),
    )
    return out.withColumn("dt", F.to_date("at")).withColumn(
        "index", F.concat_ws("-", "kafka_topic", F.date_format("at", "yyyy.MM.dd"))
    )


def write_log_index(rows: DataFrame, path: str) -> None:
    """Daily folders per topic; a topic that holds most rows is split over many tasks."""
    rows.hint("rebalance", "kafka_topic", "dt").write.mode("append").partitionBy("kafka_topic", "dt").parquet(path)


def recent_count(df: DataFrame, as_of: Column, measurement: str | None = None, minutes: int = 2) -> DataFrame:
    """Points of the last minutes before ``as_of``, optionally of one measurement."""
    kept = df.filter((F.col("ts") >= as_of - F.make_interval(mins=F.lit(minutes))) & (F.col("ts") < as_of))
    if measurement is not None:
        kept = kept.filter(F.col("measurement") == measurement)
    return kept.agg(F.count(F.lit(1)).alias("points"))
