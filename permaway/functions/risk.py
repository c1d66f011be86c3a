"""Risk scores, tiers and prediction intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_WEIGHTS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SCORE_CAP = 4.0


def severity_weight(severity: Column) -> Column:
    """Weight of a severity name; unknown names weigh 1."""
    name = F.upper(severity)
    weight = F.lit(1)
    for known, w in SEVERITY_WEIGHTS.items():
        weight = F.when(name == known, F.lit(w)).otherwise(weight)
    return weight


def risk_score(probability: Column, weight: Column | float = SEVERITY_WEIGHTS["HIGH"]) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.least(probability * w, F.lit(SCORE_CAP))


def risk_tier(score: Column) -> Column:
    return F.when(score >= 3.2, 1).when(score >= 2.0, 2).otherwise(3)


def failure_interval(
    probability: Column,
    interpolation_pct: Column,
    quantile: Column | float = 0.15,
    base_width: Column | float | None = None,
) -> Column:
    """Interval struct ``lower``, ``upper``, widened with the share of interpolated input.

    ``base_width`` is the width of the model at 0 % interpolation; without it
    the widening is skipped. Both ends stay within 0..1 and are rounded to 4.
    """
    q = quantile if isinstance(quantile, Column) else F.lit(float(quantile))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))
    low, high = F.greatest(F.lit(0.0), p - q), F.least(F.lit(1.0), p + q)
    if base_width is not None:
        base = base_width if isinstance(base_width, Column) else F.lit(float(base_width))
        target = base * (1.0 + interpolation_pct / 20.0) + 0.0002
        short = F.when(
            (interpolation_pct > 0) & base.isNotNull(), F.greatest(F.lit(0.0), target - (high - low))
        ).otherwise(F.lit(0.0))
        low = F.greatest(F.lit(0.0), low - short / 2)
        high = F.least(F.lit(1.0), high + short / 2)
    return F.struct(F.round(low, 4).alias("lower"), F.round(high, 4).alias("upper"))


def delay_interval(point: Column, quantile: Column | float = 5.0) -> Column:
    """Struct ``point``, ``lower``, ``upper``, each rounded to 2 places."""
    q = quantile if isinstance(quantile, Column) else F.lit(float(quantile))
    return F.struct(
        F.round(point, 2).alias("point"), F.round(point - q, 2).alias("lower"), F.round(point + q, 2).alias("upper")
    )
