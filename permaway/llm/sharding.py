"""Sharding: best-fit-decreasing bin packing of indivisible groups into shards of near equal bytes.

Groups are rows of equal text. They are packed on two levels, both by best fit decreasing. First, parts of a bounded number
of groups are packed side by side into bundles, each a small fraction of a shard. Then the bundles, whose number is bounded
by the fraction and not by the rows, go into shards on the driver; the smallest capacity at which best fit decreasing needs
no more than the wanted shards is found by bisection. A group larger than a bundle is a bundle of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permaway.llm.store import Scratch, text_of

#: A bundle holds 1 / FINENESS of a shard; those of the groups that are kept back to even out the shards, 1 / EVEN of that.
FINENESS, EVEN = 256, 16
#: Groups that are packed in one run.
PART_GROUPS = 10_000
#: Slices of a group, so that rows of a hot text are numbered side by side.
SLICES = 1024
#: What each row takes besides its text.
ROW_BYTES = 8


class RoomTree:
    """Bins by remaining room: a balanced search tree (a treap with fixed priorities) of (room, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, room: int, bin_no: int) -> None:
        key = (room, bin_no)
        low, high = self._split(self.root, key)
        node = [key, (bin_no * 0x9E3779B1 + room * 0x85EBCA6B) & 0xFFFFFFFF, None, None]
        self.root = self._merge(self._merge(low, node), high)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that holds `need`; the oldest of equals."""
        low, high = self._split(self.root, (need, -1))
        if high is None:
            self.root = low
            return None
        if high[2] is None:
            found, rest = high[0], high[3]
        else:
            above, node = high, high[2]
            while node[2] is not None:
                above, node = node, node[2]
            found, above[2], rest = node[0], node[3], high
        self.root = self._merge(low, rest)
        return found

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] >= high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


class BestFit:
    """Bins of one capacity; what is larger gets a bin that is full at once."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.tree = capacity, 0, RoomTree()

    def put(self, size: int) -> int:
        """The bin of the next item; feed items by falling size."""
        found = self.tree.take_tightest(size) if size <= self.capacity else None
        if found is None:
            found = (max(self.capacity, size), self.bins)
            self.bins += 1
        if found[0] > size:
            self.tree.add(found[0] - size, found[1])
        return found[1]


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size, given by falling size, and the number of bins."""
    fit = BestFit(capacity)
    return [fit.put(int(x)) for x in sizes], fit.bins


def fewest_bytes(sizes: list[int], shards: int) -> list[int]:
    """The bin of each size, given by falling size: best fit decreasing at the smallest capacity that `shards` bins meet.

    An item of a whole bin's share or more has a bin to itself, so that the others are evened out among themselves.
    """
    if not sizes:
        return []
    if shards > 1 and sizes[0] * shards >= sum(sizes):
        return [0, *(1 + x for x in fewest_bytes(sizes[1:], shards - 1))]
    low = max(sizes[0], -(-sum(sizes) // shards))
    high, step = low, max(1, low // 1000)
    bins, used = best_fit_decreasing(sizes, high)
    while used > shards:
        low, high, step = high + 1, high + step, 2 * step
        bins, used = best_fit_decreasing(sizes, high)
    while low < high and high - low > high // 10_000:
        middle = (low + high) // 2
        tried, used = best_fit_decreasing(sizes, middle)
        if used <= shards:
            bins, high = tried, middle
        else:
            low = middle + 1
    return bins


def _bundled(groups: DataFrame, capacity: int) -> DataFrame:
    """Pack the groups of each part into bundles; adds bundle and before, the rows of the bundle before the group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, fit, rows = None, None, {}
        for batch in batches:
            bundle, before = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, (own, even, size, n) in enumerate(zip(batch["part"], batch["even"], batch["bytes"], batch["rows"], strict=True)):
                if (own, even) != part:
                    part, rows = (own, even), {}
                    fit = BestFit(max(capacity // EVEN, 1) if even else capacity)
                bundle[i] = b = fit.put(int(size))
                before[i] = rows.get(b, 0)
                rows[b] = before[i] + n
            yield batch.assign(bundle=bundle, before=before)

    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in groups.schema) + ", bundle long, before long"
    return groups.repartition("part").sortWithinPartitions("part", "even", F.desc("bytes"), "key").mapInPandas(run, kind)


def shard_by_bytes(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Size is the text's UTF-8 bytes plus ROW_BYTES. Rows of equal text stay together; a null text counts as the empty one.
    Slots run from 0 without gaps in each shard. Repeated rows and null ids are rows like any other; no rows give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = scratch.table(text_of(documents).select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"),
    ), "op1-rows")
    cells = rows.groupBy("key", "size", "slice").agg(F.count("*").alias("n"))
    groups = cells.groupBy("key", "size").agg(F.sum("n").alias("rows")).select("key", "rows", (F.col("size") * F.col("rows")).alias("bytes"))
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    capacity = max(1, -(-total // (shards * FINENESS)))
    parts = max(1, -(-count // PART_GROUPS))
    of_part = groups.select(
        "*", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"),
        ((F.col("bytes") <= capacity // EVEN) & (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(EVEN)) == 0)).alias("even"),
    )
    bundled = scratch.table(_bundled(of_part, capacity), "op1-groups")

    # At most two bundles for each share of a shard, and one for each part: bounded whatever the rows.
    bundles = bundled.groupBy("part", "even", "bundle").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).toPandas()
    bundles = bundles.sort_values(["bytes", "part", "even", "bundle"], ascending=[False, True, True, True])
    bundles["shard"] = np.array(fewest_bytes([int(x) for x in bundles["bytes"]], shards), np.int32)
    bundles["first"] = bundles.groupby("shard")["rows"].cumsum() - bundles["rows"]
    places = spark.createDataFrame(
        [(int(p), bool(e), int(b), int(s), int(f)) for p, e, b, s, f in bundles[["part", "even", "bundle", "shard", "first"]].itertuples(index=False)],
        "part long, even boolean, bundle long, shard int, first long",
    )
    placed = bundled.join(F.broadcast(places), ["part", "even", "bundle"]).select("key", "shard", (F.col("first") + F.col("before")).alias("first"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("key", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("sliced")).join(placed, "key").select(
        "key", "slice", "shard", (F.col("first") + F.col("sliced")).alias("first")
    )
    own = Window.partitionBy("key", "slice").orderBy("doc_id")
    return scratch.result(rows.join(starts, ["key", "slice"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(own) - 1).alias("slot")
    ), "op1-shards")
