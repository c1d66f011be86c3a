import json
import struct

import pytest
from pyspark.sql import functions as F

from permaway.sources import feed_source, feeds


def axle(i, axles=2):
    return b"T%07d" % i + struct.pack(">QB3x8f12x", 1_700_000_000_000 + i, axles, *range(8))


def frame(i, broken=False):
    body = {"sensor_id": f"s{i}", "train_id": "t", "sequence_no": i, "timestamp_utc": "2024-01-01T00:00:00Z"}
    body |= {} if broken else {name: i + 0.5 for name in feeds.BOGIE_NUMBERS}
    text = json.dumps(body).encode()
    return struct.pack(">I", len(text)) + text


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


@pytest.mark.parametrize("step", ["1", "100", "1000", "100000"])
def test_records_once_whatever_the_ranges(spark, tmp_path, step):
    path = write(tmp_path / "a", one=b"".join(axle(i) for i in range(50)) + b"tail", two=axle(90), none=b"", _hidden=b"x")
    rows = feed_source.read_feed(spark, "axles", path, range_bytes=step).orderBy("path", "at").collect()
    assert [bytes(r.payload) for r in rows] == [*(axle(i) for i in range(50)), b"tail", axle(90)]
    assert [r.failure for r in rows] == [None] * 50 + ["wrong length", None]
    if step == "1000":
        assert len({r.part_no for r in rows}) == 4  # one file, four tasks


@pytest.mark.parametrize("step", ["1", "700", "100000"])
def test_frames_and_lines(spark, tmp_path, step):
    path = write(tmp_path / "f", one=b"".join(frame(i, i == 7) for i in range(30)) + frame(99)[:40], two=b"\x00\x00")
    events, failures = feed_source.feed_rows(spark, "bogies", path, range_bytes=step)
    assert sorted(r.sequence for r in events.collect()) == [i for i in range(30) if i != 7]
    reasons = sorted((r.reason, r.payload) for r in failures.collect())
    assert [x for x, _ in reasons] == ["missing or unreadable field", "short frame", "short frame"]
    texts = ["é" * 40, "", "b\r", "c" * 300, "last"]
    path = write(tmp_path / "l", one="\n".join(texts).encode())
    rows = feed_source.read_feed(spark, "positions", path, range_bytes=step).orderBy("at").collect()
    assert [bytes(r.payload).decode() for r in rows] == ["é" * 40, "b", "c" * 300, "last"]


def test_same_rows_as_whole_blobs(spark, tmp_path):
    path = write(tmp_path / "w", one=b"".join(axle(i, i % 11) for i in range(40)))
    whole = feeds.FEEDS["axles"](spark.read.format("binaryFile").load(path))
    ranged = feed_source.feed_rows(spark, "axles", path, range_bytes="640")
    for a, b in zip(whole, ranged):
        key = [F.to_json(F.struct(*a.columns)).alias("row")]
        assert sorted(a.select(*key).collect()) == sorted(b.select(*key).collect())


def test_stream_reads_each_file_once(spark, tmp_path):
    path = write(tmp_path / "in", f1=axle(1) + axle(2))
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")

    def run():
        raw = feed_source.read_feed(spark, "axles", path, streaming=True, range_bytes="64")
        raw.writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(bytes(r.payload) for r in spark.read.parquet(out).collect())

    assert run() == [axle(1), axle(2)]
    write(tmp_path / "in", f2=axle(3))
    assert run() == [axle(1), axle(2), axle(3)]


def test_registered_feed_and_empty_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed_source, "CUTS", dict(feed_source.CUTS))
    monkeypatch.setattr(feed_source, "PARSERS", dict(feed_source.PARSERS))
    none = spark.createDataFrame([], "source string, payload string, reason string")
    feed_source.register_feed("notes", "lines", lambda raw: (raw.select(F.decode("payload", "UTF-8").alias("note")), none))
    train = json.dumps([{"train_number": "12", "latitude": 1.5, "longitude": 2.5, "sequence_no": 3}])
    events, failures = feed_source.feed_rows(spark, "positions", write(tmp_path / "p", one=f"{train}\nbroken\n".encode()))
    assert [r.sequence for r in events.collect()] == [3] and [r.payload for r in failures.collect()] == ["broken"]
    events, failures = feed_source.feed_rows(spark, "notes", write(tmp_path / "n", one=b"x\ny\n"))
    assert sorted(r.note for r in events.collect()) == ["x", "y"] and failures.count() == 0
    assert feed_source.read_feed(spark, "axles", write(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="no way to cut"):
        spark.read.format(feed_source.NAME).options(feed="other").load(path=str(tmp_path)).count()
