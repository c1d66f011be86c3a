"""Archive tables, audit tables, compaction and dataset registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway.functions.scalars import dataset_version_id, one_per_key, preprocessing_hash
from permaway.schemas import ARCHIVE_TABLES
from permaway.session import durable

AUDIT_DAYS = 365


def create_archive_table(spark: SparkSession, name: str, root: str, fmt: str = "parquet") -> None:
    """Create one archive table under ``root`` if it is missing."""
    schema, keys = ARCHIVE_TABLES[name]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING {fmt} "
        f"PARTITIONED BY ({', '.join(keys)}) LOCATION '{root}/{name}'"
    )


def create_archive(spark: SparkSession, root: str, fmt: str = "parquet") -> None:
    for name in ARCHIVE_TABLES:
        create_archive_table(spark, name, root, fmt)


def append_archive(df: DataFrame, name: str, root: str, fmt: str = "parquet") -> None:
    """Append rows to an archive table.

    The rebalance hint gathers the rows of a partition into few files and lets
    adaptive execution split a zone that holds most of the rows over many tasks.
    """
    _, keys = ARCHIVE_TABLES[name]
    spread = df.hint("rebalance", *keys)
    if df.sparkSession.catalog.tableExists(name):
        # Through the table, so that new partitions are known to it.
        spread.select(*df.sparkSession.table(name).columns).write.insertInto(name)
    else:
        spread.write.format(fmt).mode("append").partitionBy(*keys).save(f"{root}/{name}")


def read_archive(spark: SparkSession, name: str, root: str, fmt: str = "parquet") -> DataFrame:
    """An archive table; columns added later are merged in."""
    return spark.read.option("mergeSchema", "true").format(fmt).load(f"{root}/{name}")


def archive_rows(events: DataFrame, zone: Column, archived_at: Column) -> DataFrame:
    """Canonical events in the column layout of ``raw_sensor_events``."""
    flags = F.col("quality_flags")
    return events.select(
        F.col("eventId").alias("event_id"), F.col("sourceId").alias("source_id"),
        F.col("sensorType").alias("sensor_type"), F.col("assetId").alias("asset_id"),
        F.col("timestamp_utc").try_cast("timestamp").alias("timestamp_utc"), "sequence", zone.alias("zone"),
        F.to_json("payload").alias("payload_json"), flags["interpolated"].alias("interpolated"),
        flags["interpolation_pct"].alias("interpolation_pct"), flags["clock_reliable"].alias("clock_reliable"),
        flags["drift_ms"].alias("drift_ms"), "schema_version", archived_at.alias("archived_at"),
    )


def compact_partition(
    spark: SparkSession, path: str, keys: list[str], partition: dict[str, str], target_files: int, sort: list[str], staging: str
) -> None:
    """Rewrite the small files of one partition as ``target_files`` range-sorted files.

    ``keys`` are all partition columns of the table; ``partition`` may name some of them, which rewrites every partition below.

    The rows go to ``staging`` first, so a lost job never leaves the partition
    half written; only then is the partition overwritten from there.
    """
    rows = spark.read.parquet(path)
    for name, value in partition.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    rows.repartitionByRange(target_files, *sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(staging)
    (
        spark.read.parquet(staging)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def with_retention(df: DataFrame, created: str = "created_at", days: int = AUDIT_DAYS) -> DataFrame:
    """Add ``retain_until``."""
    return df.withColumn("retain_until", F.col(created) + F.make_interval(days=F.lit(days)))


def append_audit(df: DataFrame, path: str, created: str = "created_at") -> None:
    """The only writer of audit tables: append, never update or delete."""
    with_retention(df, created).write.mode("append").parquet(path)


def append_anomalies(anomalies: DataFrame, root: str, iec62443_zone: str, zone: Column, at: Column, fmt: str = "parquet") -> None:
    """Append the rows of ``signal.window_anomalies``: one to ``security_anomaly``, one with its raw messages to ``forensic_evidence``.

    The evidence goes first, so that no anomaly in the archive is without it. ``at`` is the time of the anomaly.
    """
    held = durable(anomalies.withColumns({"_at": at, "_zone": zone}))
    append_audit(
        held.select("alert_id", F.col("_at").alias("created_at"), F.col("reconstruction_error"), "threshold", "evidence"),
        f"{root}/forensic_evidence",
    )
    text, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    append_archive(
        held.select(
            "alert_id", F.lit(iec62443_zone).alias("iec62443_zone"), F.col("_at").alias("timestamp_utc"), "reconstruction_error", "threshold",
            "acknowledged", text.alias("acknowledged_by"), time.alias("acknowledged_at"), F.lit(False).alias("escalated"),
            F.col("alert_id").alias("forensic_artifact_id"), F.col("_zone").alias("zone"),
        ),
        "security_anomaly", root, fmt,
    )


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; of rows with one key the smallest."""
    return one_per_key(new, key).join(existing.select(*key), key, "left_anti")


def steps_as_json(steps: Column) -> Column:
    """A list of step names as JSON text with ``, `` between the entries."""
    quoted = F.transform(steps, lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.concat_ws(", ", quoted), F.lit("]"))


def register_datasets(df: DataFrame) -> DataFrame:
    """Provenance rows with version id and step hash from ``path`` and ``steps``."""
    steps = steps_as_json(F.col("steps"))
    return df.withColumns(
        {
            "dataset_version_id": dataset_version_id(F.col("path"), steps),
            "preprocessing_hash": preprocessing_hash(steps),
            "dataset_name": F.element_at(F.split("path", "/"), -1),
        }
    )


def row_count_gate(spark: SparkSession, path: str, least: int) -> DataFrame:
    """One row: the rows of a Parquet history and whether they are enough."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("passed", F.col("rows") >= least)


def images_by_class(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, class)`` of image files, without reading their content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"))
        .filter(F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp|tiff)$"))
    )
