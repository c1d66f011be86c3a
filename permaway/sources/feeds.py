"""Feed sources: topic unions and the parsers of the four raw feeds.

Every parser returns rows of the canonical event; rows that cannot be read go
to ``failures`` as ``(source, payload, reason)`` so that ordered failure
counting (operators.ordered.failure_runs) can follow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway.functions.scalars import key_hash, millis_to_timestamp, prefixed_id, strip_nulls
from permaway.schemas import RAW_FIELDS

RECORD_SIZE = 64
# Fixed layout of an axle record: 8 bytes of id, epoch ms, axle count, 3 spare,
# 8 loads, 12 spare; big-endian.
AXLE_RECORD = np.dtype(
    [("id", "S8"), ("ms", ">u8"), ("axles", "u1"), ("_a", "V3"), ("loads", ">f4", (8,)), ("_b", "V12")]
)
BOGIE_NUMBERS = [
    "vibration_rms", "vibration_kurtosis", "temperature_bogie", "wheel_load_left",
    "wheel_load_right", "acoustic_emission_rms", "speed_kmh",
]
TRAFFIC_FIELDS = ["packet_rate", "query_type_dist", "inter_arrival_ms", "payload_size", "src_ip_entropy"]


def union_topics(
    spark: SparkSession,
    paths: dict[str, str],
    *,
    fmt: str = "json",
    schema: str = RAW_FIELDS,
    streaming: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Several topic folders as one frame of raw messages with a ``topic`` column."""
    def one(topic: str, path: str) -> DataFrame:
        reader = spark.readStream if streaming else spark.read
        return reader.schema(schema).options(**(options or {})).format(fmt).load(path).withColumn("topic", F.lit(topic))

    return reduce(DataFrame.unionByName, [one(t, p) for t, p in paths.items()])


def kafka_topics(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """The same union read from a broker; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .load()
    )
    return raw.select("topic", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def _flags() -> Column:
    return F.struct(
        F.lit(False).alias("interpolated"), F.lit(0.0).alias("interpolation_pct"),
        F.lit(True).alias("clock_reliable"), F.lit(0.0).alias("drift_ms"),
    )


def _canonical(df: DataFrame, source: Column, kind: str, asset: Column, ts: Column, seq: Column, payload: Column):
    return df.select(
        key_hash(source, ts, seq).alias("eventId"),
        source.alias("sourceId"),
        F.lit(kind).alias("sensorType"),
        asset.alias("assetId"),
        ts.alias("timestamp_utc"),
        seq.cast("bigint").alias("sequence"),
        payload.alias("payload"),
        _flags().alias("quality_flags"),
        F.lit("1.0.0").alias("schema_version"),
    )


def parse_positions(df: DataFrame, value: str = "value", ingest_ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Train positions from JSON-array texts: ``(events, failures)``."""
    now = F.coalesce(ingest_ts, F.current_timestamp()) if ingest_ts is not None else F.current_timestamp()
    text = F.col(value)
    is_list = F.ltrim(text).startswith("[") & F.try_parse_json(text).isNotNull()
    listed = df.select(
        text.alias("_text"),
        now.cast("string").alias("_now"),
        F.when(is_list, F.from_json(text, "array<map<string,string>>")).alias("_records"),
    )
    rows = listed.filter(F.col("_records").isNotNull()).select("_now", F.explode("_records").alias("r"))
    r = F.col("r")
    number = lambda name, default=None: (
        r[name].try_cast("double")
        if default is None
        else F.when(F.map_contains_key(r, F.lit(name)), r[name].try_cast("double")).otherwise(F.lit(default))
    )
    typed = rows.select(
        "r",
        r["train_number"].alias("train"),
        number("latitude").alias("lat"),
        number("longitude").alias("lon"),
        number("speed_kmh", 0.0).alias("speed"),
        F.coalesce(r["station_code"], F.lit("UNKNOWN")).alias("station"),
        F.coalesce(r["timestamp"], F.col("_now")).alias("at"),
        F.when(F.map_contains_key(r, F.lit("sequence_no")), r["sequence_no"].try_cast("bigint"))
        .otherwise(F.lit(0)).alias("seq"),
    )
    readable = (
        F.col("train").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
        & F.col("speed").isNotNull() & F.col("seq").isNotNull()
    )
    events = _canonical(
        typed.filter(readable), prefixed_id("ntes", F.col("train")), "gps", prefixed_id("loco", F.col("train")),
        F.col("at"), F.col("seq"),
        F.create_map(
            F.lit("latitude"), F.col("lat").cast("string"), F.lit("longitude"), F.col("lon").cast("string"),
            F.lit("speed_kmh"), F.col("speed").cast("string"), F.lit("station_code"), F.col("station"),
        ),
    )
    bad_records = typed.filter(~readable).select(
        F.coalesce(prefixed_id("ntes", F.col("train")), F.lit("ntes")).alias("source"),
        F.to_json("r").alias("payload"), F.lit("missing or unreadable field").alias("reason"),
    )
    bad_texts = listed.filter(F.col("_records").isNull()).select(
        F.lit("ntes").alias("source"), F.col("_text").alias("payload"), F.lit("not a JSON list").alias("reason")
    )
    return events, bad_records.unionByName(bad_texts)


def split_frames(df: DataFrame, content: str = "content") -> DataFrame:
    """Cut length-prefixed blobs into ``(blob, frame_no, payload)``; a short tail gives a null payload."""

    def run(batches):
        for batch in batches:
            ids, numbers, payloads = [], [], []
            for blob_id, blob in zip(batch["blob"].to_pylist(), batch["content"].to_pylist()):
                at, number = 0, 0
                while at < len(blob or b""):
                    size = int.from_bytes(blob[at:at + 4], "big")
                    whole = len(blob) - at >= 4 and at + 4 + size <= len(blob)
                    ids.append(blob_id)
                    numbers.append(number)
                    payloads.append(blob[at + 4:at + 4 + size] if whole else None)
                    at, number = (at + 4 + size if whole else len(blob)), number + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(numbers, pa.int64()), pa.array(payloads, pa.binary())],
                names=["blob", "frame_no", "payload"],
            )

    blobs = df.select(
        (F.col("path") if "path" in df.columns else F.sha2(F.col(content), 256)).alias("blob"),
        F.col(content).alias("content"),
    )
    return blobs.mapInArrow(run, "blob string, frame_no bigint, payload binary")


def parse_bogie_frames(frames: DataFrame, payload: str = "payload", ingest_ts: Column | None = None):
    """Bogie readings from frame payloads (JSON bytes): ``(events, failures)``."""
    now = ingest_ts if ingest_ts is not None else F.current_timestamp()
    text = F.decode(F.col(payload), "UTF-8")
    typed = frames.select(
        F.col(payload).alias("_raw"), now.cast("string").alias("_now"),
        F.from_json(text, "map<string,string>").alias("r"),
    )
    r = F.col("r")
    seq = F.when(F.map_contains_key(r, F.lit("sequence_no")), r["sequence_no"].try_cast("bigint")).otherwise(F.lit(0))
    readable = r.isNotNull() & r["sensor_id"].isNotNull() & r["train_id"].isNotNull() & seq.isNotNull()
    for name in BOGIE_NUMBERS:
        readable = readable & r[name].try_cast("double").isNotNull()
    readable = F.coalesce(readable, F.lit(False))
    pairs = [x for n in BOGIE_NUMBERS for x in (F.lit(n), r[n].try_cast("double").cast("string"))]
    events = _canonical(
        typed.filter(readable), prefixed_id("omrs", r["sensor_id"]), "wheel_load", prefixed_id("loco", r["train_id"]),
        F.coalesce(r["timestamp_utc"], F.col("_now")), seq, F.create_map(*pairs),
    )
    failures = typed.filter(~readable).select(
        F.lit("omrs-stream").alias("source"), F.lower(F.hex("_raw")).alias("payload"),
        F.lit("missing or unreadable field").alias("reason"),
    )
    return events, failures


def split_records(df: DataFrame, content: str = "content") -> DataFrame:
    """Cut blobs into 64-byte records ``(record_no, record)``; a short tail stays as it is."""
    size = F.octet_length(content)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(size / RECORD_SIZE).cast("int") - 1, F.lit(0)))
    return (
        df.filter(size > 0)
        .select(content, F.explode(steps).alias("record_no"))
        .select("record_no", F.col(content).substr(F.col("record_no") * RECORD_SIZE + 1, F.lit(RECORD_SIZE)).alias("record"))
    )


def decode_axle_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Raw fields ``(record, train, ms, axles, loads)`` of 64-byte records, decoded per Arrow batch.

    Records of another length keep null fields.
    """

    def run(batches):
        for batch in batches:
            raw = batch.column(0).to_pylist()
            good = np.array([r is not None and len(r) == RECORD_SIZE for r in raw], dtype=bool)
            rows = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), dtype=AXLE_RECORD)
            place = np.cumsum(good) - 1

            def spread(values):
                return [values[p] if g else None for p, g in zip(place, good)]

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(spread([bytes(b).rstrip(b"\x00").decode("utf-8", "replace") for b in rows["id"]]), pa.string()),
                    pa.array(spread(rows["ms"].astype("int64").tolist()), pa.int64()),
                    pa.array(spread(rows["axles"].astype("int32").tolist()), pa.int32()),
                    pa.array(spread(rows["loads"].astype("float32").tolist()), pa.list_(pa.float32())),
                ],
                names=["record", "train", "ms", "axles", "loads"],
            )

    return df.select(F.col(record).alias("record")).mapInArrow(
        run, "record binary, train string, ms bigint, axles int, loads array<float>"
    )


def parse_axle_records(df: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Axle loads from 64-byte records: ``(events, failures)``; the axle count must be 1 to 8."""
    raw = decode_axle_records(df, record)
    readable = F.coalesce(F.col("axles").between(1, 8), F.lit(False))
    used = raw.filter(readable).withColumn("loads", F.expr("slice(loads, 1, axles)"))
    at = F.date_format(millis_to_timestamp(F.col("ms")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    train = strip_nulls(F.col("train"))
    events = _canonical(
        used, prefixed_id("wild", train), "wheel_load", prefixed_id("loco", train), at, F.lit(0),
        F.create_map(
            F.lit("train_id"), train, F.lit("axle_loads"), F.to_json("loads"),
            F.lit("max_load"), F.array_max("loads").cast("string"), F.lit("timestamp_utc"), at,
        ),
    )
    failures = raw.filter(~readable).select(
        F.lit("wild-stream").alias("source"), F.lower(F.hex("record")).alias("payload"),
        F.when(F.col("axles").isNull(), F.lit("wrong length")).otherwise(F.lit("axle count out of range")).alias("reason"),
    )
    return events, failures


def traffic_features(df: DataFrame, value: str = "raw") -> DataFrame:
    """Add ``features``: five traffic numbers; an unreadable message gives zeros, an absent key 0."""
    text = F.col(value)
    fields = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), "map<string,string>")
    out = df.withColumn("_fields", fields)
    r = F.col("_fields")
    numbers = [
        F.when(F.map_contains_key(r, F.lit(n)), r[n].try_cast("double")).otherwise(F.lit(0.0)) for n in TRAFFIC_FIELDS
    ]
    zeros = F.array(*[F.lit(0.0)] * len(TRAFFIC_FIELDS))
    broken = r.isNull() | reduce(lambda a, b: a | b, [x.isNull() for x in numbers])
    return out.withColumn("features", F.when(broken, zeros).otherwise(F.array(*numbers))).drop("_fields")


def to_messages(events: DataFrame, topic: Column) -> DataFrame:
    """Canonical events as ``(topic, value)`` with the JSON text as value."""
    return events.select(topic.alias("topic"), F.to_json(F.struct(*events.columns)).alias("value"))


# A feed is a name and a parser from its raw frame to (events, failures).
FEEDS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {
    "positions": parse_positions,
    "bogies": lambda df: parse_bogie_frames(split_frames(df)),
    "axles": lambda df: parse_axle_records(split_records(df)),
}


def register_feed(name: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    FEEDS[name] = parse


def observed(events: DataFrame, failures: DataFrame, adapter: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Attach ingest counters that a query listener can read as ``<adapter>:<version>:...``."""
    return (
        events.observe(f"{adapter}:{version}:events", F.count(F.lit(1)).alias("events")),
        failures.observe(f"{adapter}:{version}:failures", F.count(F.lit(1)).alias("parse_failures")),
    )
