"""Validation, fan-out, feeds, points and archives on small hand-made input."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from permaway.operators import rules, validate
from permaway.schemas import ARCHIVE_TABLES
from permaway.sources import archive, feeds, series


def event(**changes):
    base = {
        "eventId": "0b0f7e1c-58d4-4a0e-9f57-111111111111", "sourceId": "s1", "sensorType": "vibration", "assetId": "zone-a-track-042",
        "timestamp_utc": "2024-06-01T10:30:00Z", "sequence": 1, "payload": {"rms": 0.12, "unit": "g"},
        "quality_flags": {"interpolated": False, "interpolation_pct": 0.0, "clock_reliable": True, "drift_ms": 5.0}, "schema_version": "1.0.0",
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


CASES = [
    ("valid", event(), "", "", ""),
    ("whole float", event(sequence=1.0), "", "", ""),
    ("fraction", event(sequence=1.5), "sequence:not an integer", None, None),
    ("boolean", event(sequence=True), "sequence:not an integer", None, None),
    ("negative", event(sequence=-1), "sequence:below minimum", None, None),
    ("missing", event(assetId=...), "(root):missing assetId", None, None),
    ("empty id", event(sourceId=""), "sourceId:too short", None, None),
    ("extra key", event(zone="a"), "", "(root):unknown key", "(root):unknown key"),
    ("empty payload", event(payload={}), "", "payload:empty", ""),
    ("payload list", event(payload=[1]), "payload:not an object", None, None),
    ("not uuid", event(eventId="e1"), "", "", "eventId:not a uuid"),
    ("bad time", event(timestamp_utc="yesterday"), "", "", "timestamp_utc:not a date-time"),
    ("bad version", event(schema_version="1.0"), "", "", "schema_version:not a version"),
    ("enum", event(sensorType="sonar"), "sensorType:not in enum", None, None),
    ("number for text", event(sensorType=5), "sensorType:not a string;sensorType:not in enum", None, None),
    ("pct 100", event(quality_flags={"interpolated": False, "interpolation_pct": 100, "clock_reliable": True, "drift_ms": 0}), "", "", ""),
    ("pct over", event(quality_flags={"interpolated": False, "interpolation_pct": 100.1, "clock_reliable": True, "drift_ms": 0}), "quality_flags/interpolation_pct:above maximum", None, None),
    ("no flag", event(quality_flags={"interpolated": False, "interpolation_pct": 1, "clock_reliable": True}), "quality_flags:missing drift_ms", None, None),
    ("list", [1, 2], "(root):not an object", None, None),
]


@pytest.mark.parametrize("strictness,column", [("lenient", 2), ("strict", 3), ("formats", 4)])
def test_validation_cases(spark, strictness, column):
    rows = [(c[0], "t", json.dumps(c[1])) for c in CASES] + [("broken", "t", "{oops"), ("none", "t", None)]
    df = spark.createDataFrame(rows, "name string, topic string, value string")
    text = F.concat_ws(";", F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["message"])))
    got = {r["name"]: (r["ok"], r["text"]) for r in validate.validate_events(df, strictness).select("name", "ok", text.alias("text")).collect()}
    for case in CASES:
        expected = case[column] if case[column] is not None else case[2]
        assert got[case[0]] == (expected == "", expected), case[0]
    assert got["broken"] == (False, "(root):not JSON") and got["none"] == (False, "(root):not JSON")


def test_fan_out_cuts_text(spark):
    long = "x" * 5000
    df = spark.createDataFrame([("t", long), ("t", json.dumps(event()))], "topic string, value string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows = {r["kind"]: r for r in validate.fan_out(validate.validate_events(df)).collect()}
    assert set(rows) == {"valid", "dead_letter", "alert"}
    assert rows["valid"]["target"] == "t_validated"
    assert len(json.loads(rows["dead_letter"]["body"])["raw_payload"]) == 4096
    assert len(json.loads(rows["alert"]["body"])["raw_payload_excerpt"]) == 512
    again = {r["kind"]: r for r in validate.fan_out(validate.validate_events(df)).collect()}
    assert rows["alert"]["body"] == again["alert"]["body"]


def test_position_feed(spark):
    good = {"train_number": "12345", "latitude": 28.6139, "longitude": 77.2090, "speed_kmh": 95.5, "station_code": "NDLS", "timestamp": "2024-06-01T10:30:00+00:00", "sequence_no": 42}
    bare = {"train_number": 7, "latitude": "1.5", "longitude": 2}
    texts = [json.dumps([good, bare])] + [json.dumps([{k: v for k, v in good.items() if k != gone}]) for gone in ("train_number", "latitude", "longitude")] + ['{"a":1}', "nope"]
    ok, bad = feeds.parse_positions(spark.createDataFrame([(t,) for t in texts], "value string"))
    rows = {r["sourceId"]: r for r in ok.collect()}
    assert set(rows) == {"ntes-12345", "ntes-7"}
    assert rows["ntes-12345"]["payload"]["speed_kmh"] == "95.5" and rows["ntes-12345"]["sequence"] == 42
    assert rows["ntes-7"]["payload"]["station_code"] == "UNKNOWN" and rows["ntes-7"]["payload"]["speed_kmh"] == "0.0"
    assert bad.count() == 5


def test_bogie_feed(spark):
    record = {"sensor_id": "S001", "train_id": "T100", "sequence_no": 3, **{n: 1.25 for n in feeds.BOGIE_NUMBERS}}
    frame = lambda o: struct.pack(">I", len(o)) + o
    broken = dict(record); del broken["speed_kmh"]
    blob = frame(json.dumps(record).encode()) + frame(json.dumps(broken).encode()) + frame(b"zz") + b"\x00\x00\x00\x50abc"
    frames = feeds.split_frames(spark.createDataFrame([(bytearray(blob),)], "content binary"))
    ok, bad = feeds.parse_bogie_frames(frames)
    assert [r["assetId"] for r in ok.collect()] == ["loco-T100"]
    assert bad.count() == 3


def test_axle_feed(spark):
    pack = lambda name, n, loads: struct.pack(">8sQB3x8f12x", name.encode(), 1717237800123, n, *loads, *[0.0] * (8 - len(loads)))
    blob = pack("TR56789", 4, [95.0, 97.5, 96.0, 98.2]) + pack("BAD", 0, []) + pack("BAD9", 9, [1.0] * 8) + b"short"
    records = feeds.split_records(spark.createDataFrame([(bytearray(blob),)], "content binary"))
    ok, bad = feeds.parse_axle_records(records)
    (row,) = ok.collect()
    assert row["sourceId"] == "wild-TR56789" and row["timestamp_utc"].startswith("2024-06-01T10:30:00.123")
    assert json.loads(row["payload"]["axle_loads"])[:3] == [95.0, 97.5, 96.0] and float(row["payload"]["max_load"]) == pytest.approx(98.2, rel=1e-6)
    assert sorted(r["reason"] for r in bad.collect()) == ["axle count out of range"] * 2 + ["wrong length"]


def test_points_keep_types(spark):
    value = json.dumps(event(payload={"rms": 1, "text": "5", "flag": True, "gone": None}))
    (p,) = series.to_points(spark.createDataFrame([("t", value)], "topic string, value string")).collect()
    assert p["numbers"] == {"rms": 1.0, "flag": 1.0} and p["texts"] == {"text": "5"}
    assert p["tags"]["zone"] == "unknown" and p["measurement"] == "vibration"


def test_write_retry_keeps_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "event_id int, v string")
    tries = []

    def fail(_):
        tries.append(1)
        raise OSError("store is down")

    assert not series.write_with_retry(df, fail, f"{tmp_path}/failed", f"{tmp_path}/alerts", delays=(0.0, 0.0))
    assert len(tries) == 3
    assert spark.read.parquet(f"{tmp_path}/failed").count() == 2
    assert spark.read.parquet(f"{tmp_path}/alerts").first()["events"] == 2
    long_ = lambda d: (_ for _ in ()).throw(OSError("down " * 400))
    assert not series.write_with_retry(df, long_, f"{tmp_path}/failed", f"{tmp_path}/alerts", topic="gps", delays=())
    assert {r["topic"]: r["depth"] for r in series.failure_depth(spark.read.parquet(f"{tmp_path}/failed")).collect()} == {None: 2, "gps": 2}
    assert max(len(r["reason"]) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) >= 2000
    assert series.write_with_retry(df, lambda d: d.count(), f"{tmp_path}/failed", f"{tmp_path}/alerts")


def test_archive_round(spark, tmp_path):
    root = str(tmp_path)
    spark.sql("CREATE DATABASE IF NOT EXISTS archive_test")
    spark.catalog.setCurrentDatabase("archive_test")
    try:
        for name in ARCHIVE_TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        archive.create_archive(spark, root)
        archive.create_archive(spark, root)
        assert {t.name for t in spark.catalog.listTables()} >= set(ARCHIVE_TABLES)
    finally:
        for name in ARCHIVE_TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.setCurrentDatabase("default")
    columns = "alert_id string, asset_id string, failure_probability double, zone string"
    for i in range(3):
        archive.append_archive(spark.createDataFrame([(f"a{i}", "x", 0.5, "north"), (f"b{i}", "y", 0.7, "south")], columns), "maintenance_advisories", root)
    path = f"{root}/maintenance_advisories"
    for _ in range(2):
        archive.compact_partition(spark, path, ["zone"], {"zone": "north"}, 1, ["asset_id", "alert_id"], f"{root}/staging")
        rows = archive.read_archive(spark, "maintenance_advisories", root)
        assert rows.count() == 6 and rows.filter("zone = 'south'").count() == 3
    import glob

    assert len(glob.glob(f"{path}/zone=north/*.parquet")) == 1


def test_compaction_of_two_keys(spark, tmp_path):
    path = f"{tmp_path}/events"
    columns = "event_id string, zone string, sensor_type string"
    for i in range(3):
        rows = [(f"a{i}", "z1", "o'clock"), (f"b{i}", "z1", "plain"), (f"c{i}", "z2", "plain")]
        spark.createDataFrame(rows, columns).write.mode("append").partitionBy("zone", "sensor_type").parquet(path)
    archive.compact_partition(spark, path, ["zone", "sensor_type"], {"zone": "z1"}, 2, ["event_id"], f"{tmp_path}/one")
    archive.compact_partition(spark, path, ["zone", "sensor_type"], {"zone": "z1", "sensor_type": "o'clock"}, 1, ["event_id"], f"{tmp_path}/two")
    rows = spark.read.parquet(path)
    assert rows.count() == 9 and rows.filter(F.col("sensor_type") == "o'clock").count() == 3
    assert sorted(rows.columns) == ["event_id", "sensor_type", "zone"]


def test_appended_rows_are_in_the_table(spark, tmp_path):
    root, name = str(tmp_path), "maintenance_advisories"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        archive.create_archive_table(spark, name, root)
        full = spark.table(name)
        row = spark.createDataFrame([("a", "north")], "alert_id string, zone string")
        df = row.select(*[F.col(c.name) if c.name in row.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in full.schema])
        archive.append_archive(df.select(*reversed(df.columns)), name, root)
        spark.catalog.refreshTable(name)
        assert [(r["alert_id"], r["zone"]) for r in spark.table(name).collect()] == [("a", "north")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_recent_points_end_at_as_of(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-01 11:59:00', timestamp'2024-01-01 12:00:30', timestamp'2024-02-01 00:00:00')) AS ts, 'm' AS measurement")
    assert series.recent_count(df, F.lit("2024-01-01 12:00:00").cast("timestamp")).first()["points"] == 1


def test_repeats_do_not_depend_on_the_plan(spark):
    new = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 9, "z")], "k int, v int, w string")
    for df in (new, new.orderBy("v")):
        kept = archive.insert_or_ignore(new.filter("k = 2"), df, ["k"]).collect()
        assert [tuple(r) for r in kept] == [(1, 2, "y")]


def test_audit_and_registration(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-01")], "id string, created string").select("id", F.col("created").cast("timestamp").alias("created_at"))
    archive.append_audit(df, f"{tmp_path}/audit")
    archive.append_audit(df, f"{tmp_path}/audit")
    assert [str(r["retain_until"]) for r in spark.read.parquet(f"{tmp_path}/audit").collect()] == ["2024-12-31 00:00:00"] * 2
    import hashlib

    (row,) = archive.register_datasets(spark.createDataFrame([("data/x", ["crop", "scale"])], "path string, steps array<string>")).collect()
    steps = json.dumps(["crop", "scale"])
    assert row["dataset_version_id"] == hashlib.sha256(f"data/x::{steps}".encode()).hexdigest()[:32]
    assert row["preprocessing_hash"] == hashlib.sha256(steps.encode()).hexdigest()[:16] and row["dataset_name"] == "x"


def test_images(spark, tmp_path):
    for name in ("crack/a.JPG", "crack/b.txt", "spalling/c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xx")
    rows = archive.images_by_class(spark, str(tmp_path))
    assert sorted((r["class"], r["length"]) for r in rows.collect()) == [("crack", 2), ("spalling", 2)]
    assert archive.row_count_gate(spark, "/root/testdata/sf0.001/events.parquet", 1000).first()["passed"]


def test_float_guard(spark):
    df = spark.createDataFrame([(1, [1.0], ["a"])], "id int, good array<double>, bad array<string>")
    rules.require_float_arrays(df, ["good"])
    with pytest.raises(TypeError):
        rules.require_float_arrays(df, ["bad"])
