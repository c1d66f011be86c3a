"""Feeds as a data source: ``spark.read.format("corridor_feed").option("feed", "axles").load(path)``.

A file is read in byte ranges, one task each, so its size bounds neither a task nor a row. Records of fixed size are cut
at multiples of the size. Length-prefixed frames have no marks to find a start by, so a pass over the four-byte prefixes
alone, which seeks over the payloads, notes a start for each range; it runs where the source is planned and keeps one
number a range. As a stream, each file is read once; names must rise in the order of arrival.

Rows are ``(path, part_no, at, payload, failure)``: the place of the record in its file, its bytes, and the reason if it is
cut short. ``feed_rows`` parses them by the feed's name and gives events and failures. Paths are opened by PyArrow, so a
folder must be one that the driver and all tasks reach (a mounted one, or a URI that PyArrow knows).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from permaway.sources import feeds

NAME = "corridor_feed"
SCHEMA = "path string, part_no int, at bigint, payload binary, failure string"
#: Bytes of a range unless the option range_bytes says otherwise, and bytes of records that a batch holds.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: How the files of a feed are cut.
CUTS = {"axles": "records", "bogies": "frames", "positions": "lines"}
# Parsers of raw records by feed; register_feed adds to them.
PARSERS = {
    "axles": lambda raw: feeds.parse_axle_records(raw, "payload"),
    "bogies": lambda raw: feeds.parse_bogie_frames(raw, "payload"),
    "positions": lambda raw: feeds.parse_positions(raw.withColumn("value", F.decode("payload", "UTF-8"))),
}


@dataclass
class Range(InputPartition):
    """Bytes of a file in which records start."""

    path: str
    number: int
    begin: int
    end: int


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner))


def _files(path: str) -> list[tuple[str, int]]:
    """Files of a folder, or the file itself, with their sizes, by name."""
    scheme, mark, _ = path.partition("://")
    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    start = f"{scheme}{mark}" if mark else ""
    return sorted((start + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def frame_starts(path: str, size: int, step: int) -> list[int]:
    """The first frame start at or after each multiple of `step`; only prefixes are read."""
    at, starts, wanted = 0, [], 0
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        while at < size:
            if at >= wanted:
                starts.append(at)
                wanted = (at // step + 1) * step
            file.seek(at)
            prefix = file.read(4)
            at += 4 + int.from_bytes(prefix, "big") if len(prefix) == 4 else size
    return starts


def ranges(path: str, size: int, cut: str, step: int) -> list[Range]:
    """Ranges of a file; together they hold each record once."""
    if cut == "frames":
        starts = frame_starts(path, size, step)
    else:
        step = max(step // feeds.RECORD_SIZE, 1) * feeds.RECORD_SIZE if cut == "records" else step
        starts = list(range(0, size, step))
    return [Range(path, i, a, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], size]))]


def _records(file, part: Range) -> Iterator[tuple[int, bytes, str | None]]:
    file.seek(part.begin)
    for at in range(part.begin, part.end, feeds.RECORD_SIZE):
        payload = file.read(min(feeds.RECORD_SIZE, part.end - at))
        yield at, payload, None if len(payload) == feeds.RECORD_SIZE else "wrong length"


def _frames(file, part: Range) -> Iterator[tuple[int, bytes, str | None]]:
    """Frames; what is left of one that is cut short is its payload."""
    file.seek(part.begin)
    at = part.begin
    while at < part.end:
        prefix = file.read(min(4, part.end - at))
        length = int.from_bytes(prefix, "big")
        whole = len(prefix) == 4 and at + 4 + length <= part.end
        payload = file.read(length if whole else part.end - at - len(prefix))
        yield at, payload, None if whole else "short frame"
        at = at + 4 + length if whole else part.end


def _lines(file, part: Range) -> Iterator[tuple[int, bytes, str | None]]:
    """Lines that start in the range; the last may end behind it."""
    file.seek(max(part.begin - 1, 0))
    at = file.seek(part.begin - 1) + len(file.readline()) if part.begin else 0  # behind a line that starts before
    while at < part.end:
        line = file.readline()
        if text := line.rstrip(b"\r\n"):
            yield at, text, None
        at += len(line)


READ = {"records": _records, "frames": _frames, "lines": _lines}


def read_range(part: Range, cut: str) -> Iterator[pa.RecordBatch]:
    """The records of a range in Arrow batches of bounded size."""
    names = ["path", "part_no", "at", "payload", "failure"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    with _open(part.path) as file:
        for at, payload, failure in READ[cut](file, part):
            rows.append((part.path, part.number, at, payload, failure))
            held += len(payload) + 64
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


class _Settings:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, feed = options["path"], options.get("feed")
        self.cut = options.get("cut") or CUTS.get(feed)
        if self.cut not in READ:
            raise ValueError(f"no way to cut the feed {feed!r}: set the option cut to one of {', '.join(READ)}")
        self.step = int(options.get("range_bytes", RANGE_BYTES))
        if self.step < 1:
            raise ValueError("range_bytes must be positive")

    def parts(self, files: list[tuple[str, int]]) -> list[Range]:
        return [part for path, size in files for part in ranges(path, size, self.cut, self.step)]


class FeedReader(_Settings, DataSourceReader):
    def partitions(self) -> list[Range]:
        # Spark asks for one partition at least.
        return self.parts(_files(self.path)) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_range(partition, self.cut)


class FeedStreamReader(_Settings, DataSourceStreamReader):
    """Files in the order of their names; a batch holds those behind the last name seen."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max((x for x, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.parts([x for x in _files(self.path) if start["last"] < x[0] <= end["last"]])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition, self.cut)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))


def register_feed(name: str, cut: str, parse) -> None:
    """Add a feed: how its files are cut, and its parser from raw records to (events, failures)."""
    CUTS[name], PARSERS[name] = cut, parse


def read_feed(spark: SparkSession, feed: str, path: str, *, streaming: bool = False, **options: str) -> DataFrame:
    """Raw records of a feed."""
    spark.dataSource.register(FeedSource)
    reader = spark.readStream if streaming else spark.read
    return reader.format(NAME).options(feed=feed, cut=CUTS[feed], **options).load(path)


def feed_rows(spark: SparkSession, feed: str, path: str, *, streaming: bool = False, **options: str) -> tuple[DataFrame, DataFrame]:
    """``(events, failures)`` of a feed by its name; records that are cut short are failures."""
    raw = read_feed(spark, feed, path, streaming=streaming, **options)
    cut = raw.filter(F.col("failure").isNotNull()).select(
        F.lit(feed).alias("source"), F.lower(F.hex("payload")).alias("payload"), F.col("failure").alias("reason")
    )
    events, failures = PARSERS[feed](raw.filter(F.col("failure").isNull()))
    return events, failures.unionByName(cut)
