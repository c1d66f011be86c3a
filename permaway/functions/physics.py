"""Adhesion, resistance, brake fade, stopping distance and bearing frequencies as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.81
AIR_DENSITY = 1.225
REFERENCE_SPEED_MS = 25.0

# Rail condition: (speed reduction, base adhesion) from worst to best (fixed values).
RAIL_LEAF = (0.40, 0.08)
RAIL_CONTAMINATED = (0.30, 0.12)
RAIL_WET = (0.25, 0.18)
RAIL_DAMP = (0.20, 0.25)
RAIL_DRY = (0.15, 0.35)


def _num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def adhesion(
    speed_kmh: Column,
    vibration_rms: Column,
    humidity_pct: Column | float = 50.0,
    leaf: Column | None = None,
) -> Column:
    """Wheel-rail adhesion from rail condition, speed decay and vibration, within 0.02..0.40.

    Without ``leaf``, vibration above 4 stands for debris on the rail.
    """
    humidity = _num(humidity_pct)
    leaf = vibration_rms > 4.0 if leaf is None else leaf

    def by_condition(slot: int) -> Column:
        return (
            F.when(leaf, F.lit(RAIL_LEAF[slot]))
            .when(vibration_rms > 3.0, F.lit(RAIL_CONTAMINATED[slot]))
            .when((vibration_rms > 2.0) | (humidity > 85), F.lit(RAIL_WET[slot]))
            .when(humidity > 70, F.lit(RAIL_DAMP[slot]))
            .otherwise(F.lit(RAIL_DRY[slot]))
        )

    v = F.greatest(speed_kmh / 3.6, F.lit(0.1))
    decay = 1.0 - by_condition(0) * (1.0 - F.exp(-v / REFERENCE_SPEED_MS))
    slip = F.greatest(F.lit(0.0), 1.0 - 0.03 * F.greatest(F.lit(0.0), vibration_rms - 1.0))
    return F.greatest(F.lit(0.02), F.least(F.lit(0.40), by_condition(1) * decay * slip))


def running_resistance(
    speed_kmh: Column, mass_t: Column | float, length_m: Column | float, area_m2: Column | float
) -> Column:
    """Newtons per tonne: bearing, flange and air terms."""
    per_metre = _num(mass_t) / F.greatest(_num(length_m), F.lit(1.0))
    return 1.5 + 0.0075 * speed_kmh + 0.00014 * (_num(area_m2) / per_metre) * speed_kmh * speed_kmh


def air_drag(speed_kmh: Column, area_m2: Column | float, drag: Column | float = 0.45) -> Column:
    v = speed_kmh / 3.6
    return 0.5 * AIR_DENSITY * _num(drag) * _num(area_m2) * v * v


def curve_resistance(radius_m: Column) -> Column:
    """Newtons per tonne; a radius of 0 or less means straight track."""
    return F.when(radius_m > 0, 700.0 / radius_m).otherwise(F.lit(0.0))


def brake_fade(speed_kmh: Column, duration_s: Column, ambient_c: Column | float = 35.0) -> Column:
    """Remaining brake effect within 0.5..1 after ``duration_s`` of braking."""
    v = speed_kmh / 3.6
    heat = 1.0 + F.greatest(F.lit(0.0), _num(ambient_c) - 30.0) * 0.005
    fade = 1.0 - 0.15 * heat * (1.0 - F.exp(-(v * v * duration_s) / 50_000.0))
    return F.when(duration_s <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), fade)))


def certified_distance(speed_kmh: Column) -> Column:
    """Worst-case stopping distance: 3 s reaction, 7 s propagation at 0.9, adhesion 0.08, 70 % braked."""
    v = speed_kmh / 3.6
    return v * 3.0 + v * 7.0 * 0.9 + (v * v * 1.04) / (2 * 0.08 * GRAVITY * 0.70)


def bearing_frequencies(
    shaft_rpm: Column, balls: int = 8, ball_mm: float = 12.0, pitch_mm: float = 50.0, contact_deg: float = 0.0
) -> Column:
    """Struct of outer race, inner race, ball spin and cage frequencies in Hz."""
    hz = shaft_rpm / 60.0
    ratio = ball_mm / pitch_mm * math.cos(math.radians(contact_deg))
    return F.struct(
        (balls / 2 * hz * (1 - ratio)).alias("bpfo"),
        (balls / 2 * hz * (1 + ratio)).alias("bpfi"),
        (pitch_mm / (2 * ball_mm) * hz * (1 - ratio ** 2)).alias("bsf"),
        (hz / 2 * (1 - ratio)).alias("ftf"),
    )
