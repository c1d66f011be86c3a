"""Corridor dimensions: stations, segments, zones, train classes and configurations.

All of them are fixed value lists of a few rows each, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, km, platforms, importance.
STATIONS = [
    ("NDLS", 0.0, 6, 1.0),
    ("ANVT", 14.0, 4, 0.7),
    ("GZB", 27.0, 4, 0.8),
    ("MURN", 43.0, 2, 0.4),
    ("MODI", 54.0, 2, 0.4),
    ("MERT", 72.0, 5, 0.9),
]

# Id, start km, end km, maximum speed, capacity.
SEGMENTS = [
    ("seg-ndls-anvt", 0.0, 14.0, 80, 2),
    ("seg-anvt-gzb", 14.0, 27.0, 110, 1),
    ("seg-gzb-murn", 27.0, 43.0, 130, 1),
    ("seg-murn-modi", 43.0, 54.0, 130, 1),
    ("seg-modi-mert", 54.0, 72.0, 130, 1),
]

# Zone, stations, segments.
ZONES = [
    ("scr-north", ["HYB", "SC", "BZA"], ["SEG-001", "SEG-002", "SEG-003"]),
    ("scr-central", ["GTL", "GNT", "NZB"], ["SEG-010", "SEG-011", "SEG-012"]),
    ("scr-south", ["MAS", "AJJ", "RU"], ["SEG-020", "SEG-021", "SEG-022"]),
    ("scr-west", ["SUR", "WD", "PVR"], ["SEG-030", "SEG-031", "SEG-032"]),
]

# Class, priority, speed in km/h; the first contained name wins.
TRAIN_CLASSES = [
    ("Rajdhani", 1, 130),
    ("Shatabdi", 1, 130),
    ("Vande-Bharat", 1, 160),
    ("Duronto", 2, 120),
    ("Garib-Rath", 3, 110),
    ("Jan-Shatabdi", 3, 110),
    ("Mail", 4, 100),
    ("Express", 4, 100),
    ("Passenger", 5, 80),
    ("Freight", 6, 60),
]
PASSENGERS_BY_PRIORITY = {1: 800, 2: 600, 3: 450, 4: 300, 5: 200, 6: 0}

# Type, mass t, braked %, frontal area, rotating factor, length, reaction s, propagation s.
TRAIN_CONFIGS = [
    ("vande_bharat", 430.0, 100.0, 11.5, 1.08, 260.0, 1.5, 1.0),
    ("wap7_rajdhani", 980.0, 85.0, 13.0, 1.05, 420.0, 2.0, 4.5),
    ("wdp4d_mail", 1400.0, 75.0, 13.5, 1.04, 550.0, 2.5, 6.0),
    ("default", 580.0, 90.0, 12.5, 1.06, 260.0, 2.0, 3.5),
]
CONFIG_FIELDS = ["mass_t", "braked_pct", "area_m2", "rotating", "length_m", "reaction_s", "propagation_s"]


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIONS, "id string, km double, platforms int, importance double")


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *s) for i, s in enumerate(SEGMENTS)],
        "seg_order int, id string, start_km double, end_km double, max_speed int, capacity int",
    )


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone string, stations array<string>, segments array<string>")


def train_class(train_id: Column) -> Column:
    """Class of a train by the name its id contains; Express when none does."""
    out = F.lit("Express")
    for name, _, _ in reversed(TRAIN_CLASSES):
        out = F.when(F.lower(train_id).contains(name.lower()), F.lit(name)).otherwise(out)
    return out


def class_priority(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for c in TRAIN_CLASSES for x in c[:2]])[name], F.lit(4))


def class_speed(name: Column) -> Column:
    return F.coalesce(
        F.create_map(*[x for c in TRAIN_CLASSES for x in (F.lit(c[0]), F.lit(c[2]))])[name], F.lit(100)
    )


def class_passengers(priority: Column) -> Column:
    pairs = [F.lit(x) for kv in PASSENGERS_BY_PRIORITY.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[priority], F.lit(300))
