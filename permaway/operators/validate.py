"""Event validation, fan-out and routing on raw JSON messages.

One pass inside the JVM: the text becomes a VARIANT, every rule is a column,
and the rows for all sinks come from one ``explode``. The functions work on
batch and streaming frames alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.functions.scalars import key_hash
from permaway.schemas import (
    ALERT_TOPIC,
    DEAD_LETTER_TOPIC,
    OTHER_SENSOR_TOPIC,
    SENSOR_TYPES,
    TOPIC_BY_SENSOR_TYPE,
)

REQUIRED = [
    "eventId", "sourceId", "sensorType", "assetId", "timestamp_utc",
    "sequence", "payload", "quality_flags", "schema_version",
]
REQUIRED_FLAGS = ["interpolated", "interpolation_pct", "clock_reliable", "drift_ms"]

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
SEMVER_PATTERN = "^[0-9]+[.][0-9]+[.][0-9]+$"

ROOT = "(root)"


class _Field:
    """Type and value columns of one path of a message, read from the extracted struct."""

    def __init__(self, path: str):
        self.path = path.replace(".", "/")
        at = F.col("_f")[_slot(path)]
        self.type, self.text, self.number, self.keys = at["type"], at["text"], at["number"], at["keys"]
        self.present = self.type.isNotNull()
        self.is_text = self.type == "STRING"
        self.is_number = self.type.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
        self.is_object = self.type.startswith("OBJECT")
        self.is_flag = self.type == "BOOLEAN"


def _slot(path: str) -> str:
    return path.replace(".", "_")


def _open(df: DataFrame, value: str, strictness: str) -> DataFrame:
    """Add ``_f``: type, text, number and keys of every path, each looked up once per message.

    One cast turns the message into a struct of variants, which is far cheaper
    than a path lookup per field.
    """
    with_keys = strictness != "lenient"
    texts = ["sourceId", "sensorType", "assetId"]
    if strictness == "formats":
        texts += ["eventId", "timestamp_utc", "schema_version"]
    numbers = ["sequence", "quality_flags.interpolation_pct"]
    keyed = ["payload", "quality_flags"] if with_keys else []
    fields = lambda names: "struct<" + ",".join(f"{n}: variant" for n in names) + ">"
    opened = (
        df.withColumn("_event", F.try_parse_json(F.col(value)))
        .withColumn("_top", F.try_variant_get("_event", "$", fields(REQUIRED)))
        .withColumn("_flags", F.try_variant_get(F.col("_top.quality_flags"), "$", fields(REQUIRED_FLAGS)))
    )

    def part(path: str) -> Column:
        v = F.col(f"_top.{path}") if "." not in path else F.col("_flags")[path.split(".")[1]]
        pick = lambda used, kind: F.try_variant_get(v, "$", kind) if path in used else F.lit(None).cast(kind)
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")) if path in keyed else F.lit(None).cast("array<string>")
        return F.struct(
            F.schema_of_variant(v).alias("type"), pick(texts, "string").alias("text"),
            pick(numbers, "double").alias("number"), keys.alias("keys"),
        ).alias(_slot(path))

    root_keys = F.map_keys(F.try_variant_get("_event", "$", "map<string,variant>")) if with_keys else F.lit(None).cast("array<string>")
    # Objects open as a struct; anything else that parsed has no struct form.
    root = F.when(F.col("_top").isNotNull(), "OBJECT").when(F.col("_event").isNotNull(), "OTHER")
    paths = REQUIRED + [f"quality_flags.{n}" for n in REQUIRED_FLAGS]
    read = F.struct(*[part(p) for p in paths], root_keys.alias("root_keys"), root.alias("root_type"))
    return opened.withColumn("_f", read).select(*df.columns, "_f")


def _rule(path: str, message: str, broken: Column) -> tuple[str, str, Column]:
    return path, message, broken


def _text_rules(f: _Field, *, min_length: int = 0, pattern: str | None = None, label: str = "") -> list:
    rules = [_rule(f.path, "not a string", f.present & ~f.is_text)]
    if min_length:
        rules.append(_rule(f.path, "too short", f.is_text & (F.length(f.text) < min_length)))
    if pattern:
        rules.append(_rule(f.path, f"not a {label}", f.is_text & ~f.text.rlike(pattern)))
    return rules


def _extra_keys(keys: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) > 0


def event_rules(strictness: str = "lenient") -> list[tuple[str, str, Column]]:
    """The rules as (path, message, broken), sorted by path.

    ``lenient`` checks keys, types, enum and ranges; ``strict`` also refuses
    unknown keys and an empty payload; ``formats`` refuses unknown keys and
    checks the uuid, date-time and version texts.
    """
    if strictness not in ("lenient", "strict", "formats"):
        raise ValueError(strictness)
    formats = strictness == "formats"
    f = {name: _Field(name) for name in REQUIRED}
    q = {name: _Field(f"quality_flags.{name}") for name in REQUIRED_FLAGS}
    flags = f["quality_flags"]
    rules = [_rule(ROOT, f"missing {n}", ~f[n].present) for n in REQUIRED]
    rules += _text_rules(f["eventId"], pattern=UUID_PATTERN if formats else None, label="uuid")
    rules += _text_rules(f["sourceId"], min_length=1)
    rules += _text_rules(f["assetId"], min_length=1)
    rules += _text_rules(
        f["timestamp_utc"], pattern=DATE_TIME_PATTERN if formats else None, label="date-time"
    )
    rules += _text_rules(
        f["schema_version"], pattern=SEMVER_PATTERN if formats else None, label="version"
    )
    kind = f["sensorType"]
    rules += _text_rules(kind)
    rules.append(
        _rule(kind.path, "not in enum", kind.present & ~F.coalesce(kind.is_text & kind.text.isin(SENSOR_TYPES), F.lit(False)))
    )
    seq = f["sequence"]
    whole = seq.is_number & (seq.number == F.floor(seq.number))
    rules.append(_rule(seq.path, "not an integer", seq.present & ~whole))
    rules.append(_rule(seq.path, "below minimum", seq.is_number & (seq.number < 0)))
    payload = f["payload"]
    rules.append(_rule(payload.path, "not an object", payload.present & ~payload.is_object))
    rules.append(_rule(flags.path, "not an object", flags.present & ~flags.is_object))
    rules += [_rule(flags.path, f"missing {n}", flags.is_object & ~q[n].present) for n in REQUIRED_FLAGS]
    for name in ("interpolated", "clock_reliable"):
        rules.append(_rule(q[name].path, "not a boolean", q[name].present & ~q[name].is_flag))
    for name in ("interpolation_pct", "drift_ms"):
        rules.append(_rule(q[name].path, "not a number", q[name].present & ~q[name].is_number))
    pct = q["interpolation_pct"]
    rules.append(_rule(pct.path, "below minimum", pct.is_number & (pct.number < 0)))
    rules.append(_rule(pct.path, "above maximum", pct.is_number & (pct.number > 100)))
    if strictness != "lenient":
        rules.append(_rule(ROOT, "unknown key", _extra_keys(F.col("_f.root_keys"), REQUIRED)))
        rules.append(_rule(flags.path, "unknown key", flags.is_object & _extra_keys(flags.keys, REQUIRED_FLAGS)))
    if strictness == "strict":
        rules.append(_rule(payload.path, "empty", payload.is_object & (F.size(payload.keys) == 0)))
    return sorted(rules, key=lambda r: (r[0] != ROOT, r[0]))


def validate_events(df: DataFrame, strictness: str = "lenient", value: str = "value") -> DataFrame:
    """Add ``ok`` and ``errors`` (array of path and message) to raw JSON rows.

    The text is parsed once and each path read once. The errors pass through
    an ``explode`` of one entry, because a later filter on them would otherwise
    be pushed below and have the parse repeated for every rule.
    """
    error = "struct<path: string, message: string>"
    read = _open(df, value, strictness)

    def entry(path: str, message: str) -> Column:
        return F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))

    rules = event_rules(strictness)
    listed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), entry(p, m)) for p, m, bad in rules]))
    # A valid message is settled by one condition and builds no list.
    broken = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, _, bad in rules])
    found = F.when(broken, listed).otherwise(F.array().cast(f"array<{error}>"))
    errors = (
        F.when(F.col("_f.root_type").isNull(), F.array(entry(ROOT, "not JSON")))
        .when(F.col("_f.root_type") != "OBJECT", F.array(entry(ROOT, "not an object")))
        .otherwise(found)
        .cast(f"array<{error}>")
    )
    checked = read.select(*df.columns, F.explode(F.array(errors)).alias("errors"))
    return checked.withColumn("ok", F.size("errors") == 0)


def topic_for_type(sensor_type: Column) -> Column:
    """Output topic of a valid event by its sensor type."""
    topic = F.lit(OTHER_SENSOR_TOPIC)
    for name, target in TOPIC_BY_SENSOR_TYPE.items():
        topic = F.when(sensor_type == name, F.lit(target)).otherwise(topic)
    return topic


def route_valid(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``target``: the topic of each raw message; unreadable ones go to the dead letter."""
    event = F.try_parse_json(F.col(value))
    return df.withColumn(
        "target",
        F.when(
            F.schema_of_variant(event).startswith("OBJECT"),
            topic_for_type(F.coalesce(F.try_variant_get(event, "$.sensorType", "string"), F.lit(""))),
        ).otherwise(F.lit(DEAD_LETTER_TOPIC)),
    )


def fan_out(validated: DataFrame, value: str = "value", topic: str = "topic", ts: str = "ts") -> DataFrame:
    """Rows for all sinks as ``(target, kind, body, ts)``.

    A valid message goes to ``<topic>_validated``; an invalid one gives a dead
    letter (text cut to 4096) and an alert (text cut to 512).
    """
    raw = F.col(value)
    body = lambda *cols: F.to_json(F.struct(*cols))
    message_id = key_hash(F.col(topic), F.col(ts), raw)
    reason = F.element_at("errors", 1)["message"]
    valid = F.struct(
        F.concat(F.col(topic), F.lit("_validated")).alias("target"), F.lit("valid").alias("kind"), raw.alias("body")
    )
    dead = F.struct(
        F.lit(DEAD_LETTER_TOPIC).alias("target"),
        F.lit("dead_letter").alias("kind"),
        body(
            message_id.alias("dead_letter_id"), reason.alias("reason"), F.col("errors").alias("field_errors"),
            F.substring(raw, 1, 4096).alias("raw_payload"),
        ).alias("body"),
    )
    alert = F.struct(
        F.lit(ALERT_TOPIC).alias("target"),
        F.lit("alert").alias("kind"),
        body(
            F.lit("SCHEMA_VALIDATION_FAILURE").alias("alertType"), message_id.alias("alertId"),
            F.size("errors").alias("error_count"), reason.alias("reason"),
            F.substring(raw, 1, 512).alias("raw_payload_excerpt"),
        ).alias("body"),
    )
    rows = F.when(F.col("ok"), F.array(valid)).otherwise(F.array(dead, alert))
    return validated.select(F.col(ts).alias("ts"), F.explode_outer(rows).alias("_row")).select("_row.*", "ts")


def feed_alert(validated: DataFrame, value: str = "value", topic: str = "topic") -> DataFrame:
    """Short alert per invalid message: feed, error count, first 256 characters."""
    return validated.filter(~F.col("ok")).select(
        F.lit("SCHEMA_VALIDATION_FAILURE").alias("alert_type"),
        F.col(topic).alias("source_feed"),
        F.substring(value, 1, 256).alias("raw_event_snippet"),
        F.size("errors").alias("error_count"),
    )
