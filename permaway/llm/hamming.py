"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and equal codes are one entry. Queries probe all segment values within a radius that
grows from 0: once the segments up to j have been probed at radius s and the others at s - 1, every code within distance
m * s + j has been met. Met codes are verified by their whole distance; a query is done when its kth verified distance is
covered, and until then only segments that can still bring a nearer code are probed. A code counts where it is met first:
in the first of its segments that differ least from the query's. So no query meets a code twice, in whatever rounds.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permaway.llm.store import Scratch

BITS = 64
#: Codes of one segment value, at least, about. A value to probe costs as much as verifying some dozens of codes, and narrower segments have far fewer values.
CODES_A_VALUE = 64
#: Values that one task makes to probe, about.
TASK_VALUES = 1 << 19


def sign_code(vector: str) -> Column:
    """Signs of the first 64 numbers of an array column as bits; absent and null numbers give 0, a null array null."""
    bits = F.lit(0).cast("long")
    for i in range(BITS):
        bits = bits.bitwiseOR(F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(F.col(vector).isNotNull(), bits)


def segment_count(codes: int) -> int:
    """Segments no wider than the logarithm of the number of codes over CODES_A_VALUE, so that a segment value has few codes at any size, but its neighbours are few too."""
    return min(BITS // 2, ceil(BITS / max(2.0, log2(max(codes, 2) / CODES_A_VALUE))))


def _segments(n: int) -> list[tuple[int, int]]:
    """First bit and width of each segment; the first ones are wider."""
    out, at = [], 0
    for j in range(n):
        width = BITS // n + (j < BITS % n)
        out.append((at, width))
        at += width
    return out


def _part(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _key(code: Column, segment: int, at: int, width: int) -> Column:
    """The value of a segment, with the segment's number above it."""
    return _part(code, at, width).bitwiseOR(F.lit(segment << BITS // 2).cast("long"))


def _masks(width: int, radius: int) -> Column:
    """All values of that many bits. One literal in the plan, as the thousands that wide segments have would fill the driver."""
    return F.split(F.lit(",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(width), radius))), ",").cast("array<long>")


def _probes(own: Column, masks: Column) -> Column:
    return F.transform(masks, lambda mask: own.bitwiseXOR(mask))


def _met(open_: DataFrame, rows: int, index: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """query, distance and ids of the codes within the bounds that the segment values at this distance bring, and none did before.

    open_ has so many rows of query and bound, index code, ids and key. Probes outnumber the rows that they are made of by thousands,
    which Spark's estimates leave out: so many tasks make them, and the hint keeps them from being sent to the driver and broadcast.
    """
    query, n = F.col("query"), len(segments)
    masks = {width: _masks(width, radius) for _, width in segments if width >= radius}
    probes = [
        F.when(F.lit(n * radius + j) <= F.col("bound"), _probes(_key(query, j, at, width), masks[width]))
        for j, (at, width) in enumerate(segments) if width in masks
    ]
    tasks = ceil(rows * sum(comb(width, radius) for _, width in segments) / TASK_VALUES)
    dealt = open_.repartition(max(1, tasks), "query")
    probed = dealt.select("query", "bound", F.explode(F.array(*probes)).alias("keys")).select("query", "bound", F.explode("keys").alias("key"))
    differ = query.bitwiseXOR(F.col("code"))
    distance, segment = F.bit_count(differ), F.shiftrightunsigned(index["key"], BITS // 2)
    first = (F.bit_count(_part(differ, *x)) >= F.lit(radius) + (segment > j).cast("int") for j, x in enumerate(segments))
    met = probed.hint("merge").join(index, (probed["key"] == index["key"]) & (distance <= F.col("bound")) & reduce(Column.__and__, first))
    return met.select("query", distance.alias("distance"), "ids")


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, neighbor_id and distance: the k rows nearest to each query by Hamming distance, then by id.

    rows and queries have id and code. A row with the query's own id is no neighbour. Rows without id or code are not found
    and find nothing; rows that repeat an id count once, with their least code. Fewer than k other rows give fewer neighbours.
    """
    def ready(df: DataFrame) -> DataFrame:
        return df.where("id IS NOT NULL AND code IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("code").alias("code"))

    # One more than k, for the query itself may be among them. More ids of one code can be no neighbours.
    most = k + 1
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    scratch = Scratch(rows.sparkSession)
    entries = scratch.table(
        ready(rows).withColumn("place", first).where(F.col("place") <= most).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "op7-codes"
    )
    codes, found = entries.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    wanted = min(most, found)
    n = segment_count(codes)
    segments = _segments(n)
    index = scratch.table(
        entries.select("code", "ids", F.explode(F.array(*(_key(F.col("code"), j, *x) for j, x in enumerate(segments)))).alias("key")), "op7-index"
    )
    asked = scratch.table(ready(queries), "op7-queries")
    best = None
    # bound: the distance of the last wanted row met so far.
    open_ = asked.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS))
    left = open_.count()
    radius = 0
    while codes and radius <= segments[0][1]:
        met = _met(open_, left, index, segments, radius).select("query", "distance", F.explode("ids").alias("neighbor_id"))
        nearest_first = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))
        met = met if best is None else met.unionByName(best.select("query", "distance", "neighbor_id"))
        best = scratch.table(met.withColumn("place", nearest_first).where(F.col("place") <= most), "op7-best")
        covered = n * (radius + 1) - 1
        bounds = best.groupBy("query").agg(F.when(F.count("*") >= wanted, F.max("distance")).alias("met"))
        open_ = scratch.table(
            open_.select("query").join(bounds, "query", "left").select("query", F.coalesce("met", F.lit(BITS)).alias("bound")).where(F.col("bound") > covered), "op7-open"
        )
        left = open_.count()
        if not left:
            break
        radius += 1
    if best is None:
        scratch.drop()
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    pairs = best.join(asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")), "query").where("neighbor_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return scratch.result(pairs.select("query_id", rank.alias("rank"), "neighbor_id", "distance").where(F.col("rank") <= k), "op7-nearest")
