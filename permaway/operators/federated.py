"""Vector updates of federated rounds: admission, clipping, noise, averaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.functions.arrays import clip_to_norm, gaussian_divergence, l2_norm
from permaway.functions.scalars import hashed_number
from permaway.operators.scan import ordered_scan, row_number

NOISE_SIGMA = 1.1  # noise multiplier 1.1 times the clipping norm of 1.0


def first_submissions(updates: DataFrame) -> DataFrame:
    """The first update of each station in a round."""
    rest = [c for c in updates.columns if c not in ("round_id", "station_id")]
    return updates.groupBy("round_id", "station_id").agg(
        F.min(F.struct("submitted_at", *[c for c in rest if c != "submitted_at"])).alias("_u")
    ).select("round_id", "station_id", "_u.*")


def admit_updates(
    updates: DataFrame, participants: DataFrame, *, max_norm: float = 10.0, max_drift: float = 0.15,
    closing_share: float = 0.6, clip: float = 1.0, global_mean: float = 0.0, global_var: float = 1.0,
) -> DataFrame:
    """Updates that enter each round, clipped.

    In order of arrival a station counts once it passes the norm and drift
    tests; the round closes when ``closing_share`` of its participants are in.
    """
    invited = participants.select("round_id", "station_id").distinct()
    needed = invited.groupBy("round_id").agg(F.ceil(F.count(F.lit(1)) * closing_share).alias("_needed"))
    g = F.col("gradients")
    divergence = gaussian_divergence(g, global_mean, global_var)
    fit = (
        updates.join(invited, ["round_id", "station_id"])
        .withColumns({"norm": l2_norm(g), "drift": divergence})
        .filter((F.col("norm") <= max_norm) & (F.col("drift") <= max_drift))
    )
    # A refused update leaves the station free to try again, so the first fitting one counts.
    first = first_submissions(fit)
    placed = ordered_scan(first, ["round_id"], ["submitted_at", "station_id"], [row_number("place")])
    return (
        placed.join(needed, "round_id").filter(F.col("place") <= F.col("_needed"))
        .withColumn("gradients", clip_to_norm(g, clip)).drop("_needed")
    )


def federated_average(
    updates: DataFrame, *, keys: list[str] = ["round_id"], vector: str = "gradients", weight: str | None = "sample_count", mu: float = 0.0,
    order: list[str] = ["submitted_at", "station_id"],
) -> DataFrame:
    """Average vector per round as rows ``(round, pos, average)``, damped by ``1 - mu``.

    Weighted by samples, or equally when they sum to 0. Positions become rows,
    and their partial sums, not the vectors, are shuffled. The average has the
    length of the vector that is first by ``order``; longer ones are cut.
    """
    n = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    first = F.min_by(F.size(vector), F.struct(*order))
    totals = updates.groupBy(*keys).agg(F.sum(n).alias("_w"), F.count(F.lit(1)).alias("_n"), first.alias("_length"))
    flat = updates.select(*keys, n.alias("_weight"), F.posexplode(vector).alias("pos", "x"))
    sums = flat.groupBy(*keys, "pos").agg(F.sum(F.col("x") * F.col("_weight")).alias("_s"), F.sum("x").alias("_e"))
    value = F.when(F.col("_w") != 0, F.col("_s") / F.col("_w")).otherwise(F.col("_e") / F.col("_n")) * (1.0 - mu)
    return sums.join(totals, keys).filter(F.col("pos") < F.col("_length")).select(*keys, "pos", value.alias("average"))


def private_noise(updates: DataFrame, key: str, *, vector: str = "gradients", sigma: float = NOISE_SIGMA, seed: int = 7) -> DataFrame:
    """Vectors plus Gaussian noise that depends only on the row key, position and seed.

    Two hashed uniforms per position give the normal deviate, so a re-run or a
    retried task adds the same noise.
    """
    if not 0.0 <= sigma <= 10.0:
        raise ValueError(f"sigma must be within 0..10, got {sigma}")
    if sigma == 0.0:
        return updates

    def uniform(i: Column, salt: int) -> Column:
        return (hashed_number(F.concat_ws("|", F.col(key).cast("string"), i.cast("string"), F.lit(f"{seed}|{salt}"))) + 0.5) / float(1 << 52)

    normal = lambda i: F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(2.0 * F.pi() * uniform(i, 2))
    return updates.withColumn(vector, F.transform(vector, lambda x, i: x + F.lit(sigma) * normal(i)))


def budget_left(rounds: DataFrame, *, epsilon: float = 1.0, total: float = 50.0) -> DataFrame:
    """Privacy budget after each round in order; ``noised`` until it is used up."""
    seen = ordered_scan(rounds, [], ["round_no"], [row_number("_n")])
    return seen.withColumns(
        {
            "noised": (F.col("_n") - 1) * epsilon < total,
            "remaining": F.greatest(F.lit(0.0), F.lit(total) - F.col("_n") * epsilon),
        }
    ).drop("_n")
