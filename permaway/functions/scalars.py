"""Text, time, geography, hash and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000


def prefixed_id(prefix: str, part: Column) -> Column:
    """``prefix-part``, the form of source and asset ids."""
    return F.concat_ws("-", F.lit(prefix), part.cast("string"))


def strip_nulls(text: Column) -> Column:
    """Text without its trailing NUL padding."""
    return F.regexp_replace(text, "\\x00+$", "")


def hex_payload(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def iso_timestamp(text: Column, fallback: Column | None = None) -> Column:
    """ISO-8601 text to a timestamp; unreadable text gives ``fallback`` (the ingest time)."""
    parsed = F.try_to_timestamp(text)
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def millis_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def nanos_between_ms(start_ns: Column, end_ns: Column) -> Column:
    """Milliseconds between two epoch-nanosecond columns."""
    return (end_ns - start_ns) / F.lit(1_000_000)


def minutes_to_clock(minutes: Column) -> Column:
    """Minutes since midnight as ``HH:MM:00``; hours wrap at 24."""
    m = minutes.cast("bigint")
    return F.format_string("%02d:%02d:00", F.pmod(F.floor(m / 60), F.lit(24)), F.pmod(m, F.lit(60)))


def weekday_from_sunday(ts: Column) -> Column:
    """Day of week counted from 0 = Sunday."""
    return F.dayofweek(ts) - 1


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    a = (
        F.pow(F.sin(dphi / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def numeric_fields(payload: Column) -> Column:
    """The entries of a string map that read as numbers, as doubles."""
    kept = F.map_filter(payload, lambda _, v: v.try_cast("double").isNotNull())
    return F.transform_values(kept, lambda _, v: v.try_cast("double"))


def text_fields(payload: Column) -> Column:
    """The non-null entries of a string map that do not read as numbers."""
    return F.map_filter(payload, lambda _, v: v.isNotNull() & v.try_cast("double").isNull())


def key_hash(*parts: Column) -> Column:
    """A repeatable id from key columns."""
    return F.sha2(F.concat_ws("::", *[p.cast("string") for p in parts]), 256)


def dataset_version_id(path: Column, steps_json: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", path, steps_json), 256), 1, 32)


def preprocessing_hash(steps_json: Column) -> Column:
    return F.substring(F.sha2(steps_json, 256), 1, 16)


def change_hash(*parts: Column) -> Column:
    """MD5 of the row's JSON form, equal exactly when the parts are equal."""
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def default_label(class_index: Column) -> Column:
    """A centred bounding-box label line for an image without annotation."""
    return F.format_string("%d 0.500000 0.500000 0.500000 0.400000\n", class_index)


def one_per_key(df: DataFrame, key: list[str], order: list[str] = ()) -> DataFrame:
    """The smallest row of each key by ``order`` and then by the other columns, so that a repeated task picks the same one."""
    rest = [c for c in df.columns if c not in key and c not in order]
    if not rest and not order:
        return df.distinct()
    smallest = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return smallest.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def hashed_number(text: Column, digits: int = 13) -> Column:
    """The first hexadecimal digits of the text's MD5 as a whole number, which other engines give alike."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, digits), 16, 10).cast("bigint")
