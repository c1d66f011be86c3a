"""Ordered column operators that survive a hot key.

``ordered_scan`` adds running or neighbouring values per key in a given order.
The rows are range-partitioned by (keys, order), which splits a hot key over
many chunks of equal size, written down once, scanned chunk by chunk, and
joined with the state carried in from the earlier chunks of the same key. The
carried states are at most two rows per chunk, so broadcasting them has a
fixed bound. Inputs of all sizes take this one path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from permaway.session import chunk_count, durable

CHUNK = "_chunk"


@dataclass(frozen=True)
class Scan:
    kind: str
    expr: Column
    alias: str


def previous(expr: str | Column, alias: str) -> Scan:
    """Value of the row before."""
    return Scan("previous", _col(expr), alias)


def following(expr: str | Column, alias: str) -> Scan:
    """Value of the row after."""
    return Scan("following", _col(expr), alias)


def running_sum(expr: str | Column, alias: str) -> Scan:
    return Scan("sum", _col(expr), alias)


def running_max(expr: str | Column, alias: str) -> Scan:
    return Scan("max", _col(expr), alias)


def earlier_max(expr: str | Column, alias: str) -> Scan:
    """Largest value of the rows before this one."""
    return Scan("earlier_max", _col(expr), alias)


def running_min(expr: str | Column, alias: str) -> Scan:
    return Scan("min", _col(expr), alias)


def last_known(expr: str | Column, alias: str) -> Scan:
    """Last non-null value up to and including this row."""
    return Scan("last_known", _col(expr), alias)


def next_known(expr: str | Column, alias: str) -> Scan:
    """First non-null value from this row on."""
    return Scan("next_known", _col(expr), alias)


def total(expr: str | Column, alias: str) -> Scan:
    """Sum over all rows of the key."""
    return Scan("total", _col(expr), alias)


def row_number(alias: str) -> Scan:
    return Scan("sum", F.lit(1).cast("bigint"), alias)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *stages: list[Scan],
    descending: bool = False,
) -> DataFrame:
    """Add one column per scan, computed per ``keys`` in ``order``.

    A later stage may use the columns of the stages before it; all stages
    share one chunked table. ``order`` must be unique within a key and hold no nulls.
    """
    seen = chunked(df, keys, order, descending)
    for scans in stages:
        seen = _scan_chunks(seen, keys, order, scans, descending)
    return seen.drop(CHUNK)


def chunked(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """Cut ``df`` into equal range chunks by (keys, order), numbered in ``_chunk``, and write them down."""
    sort = [F.col(k) for k in keys] + _ordering(order, descending)
    parts = chunk_count(df)
    cut = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    return durable(cut.withColumn(CHUNK, F.spark_partition_id()))


def _scan_chunks(stored, keys, order, scans, descending):
    scoped = [CHUNK, *keys]
    window = Window.partitionBy(*scoped).orderBy(*_ordering(order, descending))
    local = stored.select(
        "*",
        *[_local(s, window).alias(f"_scan_l{i}") for i, s in enumerate(scans) if s.kind != "next_known"],
        F.row_number().over(window).alias("_scan_row"),
        F.lead(F.lit(True), 1, False).over(window).alias("_scan_more"),
    ).withColumn("_scan_first", F.col("_scan_row") == 1)
    # A frame from the current row on is summed up anew for every row, so what comes next is what was last known backwards.
    back = Window.partitionBy(*scoped).orderBy(F.col("_scan_row").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumns({
        f"_scan_l{i}": F.last(s.expr, ignorenulls=True).over(back) for i, s in enumerate(scans) if s.kind == "next_known"
    })
    edges = stored.groupBy(*scoped).agg(
        *[_edge_state(s, order, descending).alias(f"_scan_s{i}") for i, s in enumerate(scans)]
    )
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = edges.select(
        *scoped,
        *[_carry(s, F.col(f"_scan_s{i}"), along, keys).alias(f"_scan_c{i}") for i, s in enumerate(scans)],
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_scan_spans"),
    ).filter("_scan_spans > 1").drop("_scan_spans")
    for name in scoped:
        carry = carry.withColumnRenamed(name, f"_scan_j{name}")
    match = reduce(
        lambda a, b: a & b,
        [F.col(CHUNK) == F.col(f"_scan_j{CHUNK}")] + [F.col(k).eqNullSafe(F.col(f"_scan_j{k}")) for k in keys],
    )
    joined = local.join(F.broadcast(carry), match, "left")
    return joined.select(
        *stored.columns,
        *[_combine(s, F.col(f"_scan_l{i}"), F.col(f"_scan_c{i}")).alias(s.alias) for i, s in enumerate(scans)],
    )


def _col(expr: str | Column) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def _ordering(order: list[str], descending: bool) -> list[Column]:
    return [F.col(o).desc() if descending else F.col(o).asc() for o in order]


def _local(scan: Scan, window: WindowSpec) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match scan.kind:
        case "previous":
            return F.lag(scan.expr).over(window)
        case "following":
            return F.lead(scan.expr).over(window)
        case "sum":
            return F.sum(scan.expr).over(upto)
        case "total":
            whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.sum(scan.expr).over(whole)
        case "max":
            return F.max(scan.expr).over(upto)
        case "earlier_max":
            return F.max(scan.expr).over(window.rowsBetween(Window.unboundedPreceding, -1))
        case "min":
            return F.min(scan.expr).over(upto)
        case "last_known":
            return F.last(scan.expr, ignorenulls=True).over(upto)
    raise ValueError(scan.kind)


def _edge_state(scan: Scan, order: list[str], descending: bool) -> Column:
    place = F.struct(*order)
    known = F.when(scan.expr.isNotNull(), place)
    last, first = (F.min_by, F.max_by) if descending else (F.max_by, F.min_by)
    match scan.kind:
        case "previous":
            return last(scan.expr, place)
        case "following":
            return first(scan.expr, place)
        case "sum" | "total":
            return F.sum(scan.expr)
        case "max" | "earlier_max":
            return F.max(scan.expr)
        case "min":
            return F.min(scan.expr)
        case "last_known":
            return last(scan.expr, known)
        case "next_known":
            return first(scan.expr, known)
    raise ValueError(scan.kind)


def _carry(scan: Scan, state: Column, along: WindowSpec, keys: list[str]) -> Column:
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    match scan.kind:
        case "previous":
            return F.lag(state).over(along)
        case "following":
            return F.lead(state).over(along)
        case "sum":
            return F.sum(state).over(before)
        case "total":
            whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.sum(state).over(whole) - F.coalesce(state, F.lit(0))
        case "max" | "earlier_max":
            return F.max(state).over(before)
        case "min":
            return F.min(state).over(before)
        case "last_known":
            return F.last(state, ignorenulls=True).over(before)
        case "next_known":
            return F.last(state, ignorenulls=True).over(back)
    raise ValueError(scan.kind)


def _combine(scan: Scan, local: Column, carry: Column) -> Column:
    match scan.kind:
        case "previous":
            return F.when(F.col("_scan_first"), carry).otherwise(local)
        case "following":
            return F.when(F.col("_scan_more"), local).otherwise(carry)
        case "sum" | "total":
            return F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)
        case "max" | "earlier_max":
            return F.greatest(local, carry)
        case "min":
            return F.least(local, carry)
        case _:
            return F.coalesce(local, carry)


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, safe for groups of any size.

    Equal values are counted on the map side first; ranks then come from an
    ordered scan over the distinct values, so no group is gathered anywhere.
    Returns keys, ``n`` and ``quantiles`` (one array entry per probability).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(counts, keys, [value], [running_sum("_n", "_upto"), total("_n", "n")])
    # A value covers the zero-based positions [_upto - _n, _upto - 1].
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (pos >= F.col("_upto") - F.col("_n")) & (pos < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}{i}"))
    edges = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)

    def interpolate(i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        return lo + (hi - lo) * (at - F.floor(at))
    return edges.select(
        *keys, "n", F.array(*[interpolate(i, p) for i, p in enumerate(probabilities)]).alias("quantiles")
    )
