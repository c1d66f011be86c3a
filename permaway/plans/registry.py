"""The registry of driver queries and the tables they read.

``user_id`` stands for an asset, source or node, ``event_type`` for a sensor or
alert type, ``value`` for a reading and ``props.k`` for a payload field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; timestamps become zoned ones in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``k`` from the payload and ``us``, the time in microseconds."""
    df = table(spark, folder, "events")
    return df.withColumns({"k": F.from_json("props", "k bigint")["k"], "us": F.unix_micros("ts")})


# The same two columns in SQL.
EVENTS_SQL = (
    "(SELECT *, CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) AS us FROM events)"
)


def sql_map(column: str, table: dict[str, str], other: str) -> str:
    """A CASE expression that maps the values of a column."""
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE '{other}' END"


def col_map(column: str, table: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out
