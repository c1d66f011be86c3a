"""Advisory stopping distances for batches of train states.

Adhesion, track geometry, train configuration and the certified distance are
columns. Only the time stepping leaves the JVM: one Arrow pass moves all rows
of a batch together and masks those that have stopped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.functions.physics import AIR_DENSITY, GRAVITY, adhesion, brake_fade, certified_distance
from permaway.operators.joins import geometry_lookup, train_config
from permaway.sources.corridor import CONFIG_FIELDS

STEP_S = 0.1
STOP_MS = 0.01
LONGEST_S = 300.0
DRAG = 0.45
RESULTS = ["reaction_m", "propagation_m", "braking_m", "brake_s", "total_time_s", "peak_decel"]


def _force_terms(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Deceleration of each row as ``mu * grip + a0 + a1 * v + a2 * v * v``, held at ``mu * g``."""
    inertia = s["mass_t"] * 1000.0 * s["rotating"]
    air = 0.5 * AIR_DENSITY * DRAG * s["area_m2"] / inertia
    wind = s["headwind_kmh"] / 3.6
    per_metre = s["mass_t"] / np.maximum(s["length_m"], 1.0)
    rolling = s["mass_t"] / inertia
    curved = s["curve_radius"] > 0
    curve = np.where(curved, 700.0 / np.where(curved, s["curve_radius"], 1.0), 0.0)
    return {
        "grip": GRAVITY * np.cos(s["gradient"]) * (s["braked_pct"] / 100.0) / s["rotating"],
        "a0": air * wind * wind + rolling * (1.5 + curve) + GRAVITY * np.sin(s["gradient"]) / s["rotating"],
        "a1": 2.0 * air * wind + rolling * 0.0075 * 3.6,
        "a2": air + rolling * 0.00014 * s["area_m2"] / per_metre * 3.6 * 3.6,
        "mu": s["mu"],
        "fade": 0.15 * (1.0 + np.maximum(0.0, s["ambient_c"] - 30.0) * 0.005),
        "ramp_s": s["propagation_s"],
    }


def _decelerate(v, mu, f):
    return np.minimum(mu * f["grip"] + f["a0"] + (f["a1"] + f["a2"] * v) * v, mu * GRAVITY)


def stop_distances(s: dict[str, np.ndarray], trim: int = 40) -> dict[str, np.ndarray]:
    """Reaction, brake build-up and full braking of all rows in step; distances in metres.

    Every ``trim`` steps the rows that have stopped leave the working arrays.
    """
    speed = np.maximum(s["speed_kmh"] / 3.6, 0.0)
    n = len(speed)
    built_up, braking, spent, peak = (np.zeros(n) for _ in range(4))
    f, v = _force_terms(s), speed.copy()
    t = 0.0
    while True:
        on = (t < f["ramp_s"]) & (v > 0)
        if not on.any():
            break
        mu = f["mu"] * (t / np.maximum(f["ramp_s"], 0.1))
        v = np.where(on, np.maximum(0.0, v - _decelerate(v, mu, f) * STEP_S), v)
        built_up += np.where(on, v * STEP_S, 0.0)
        t += STEP_S
    at, t, step = np.flatnonzero(v > STOP_MS), 0.0, 0
    f, v = {k: x[at] for k, x in f.items()}, v[at]
    far, time, top = (np.zeros(len(at)) for _ in range(3))
    while len(at):
        on = v > STOP_MS
        if step % trim == 0 or not on.any() or t > LONGEST_S:
            done = ~on if t <= LONGEST_S else np.ones(len(at), dtype=bool)
            braking[at[done]], spent[at[done]], peak[at[done]] = far[done], time[done], top[done]
            left = ~done
            at, v, far, time, top, on = at[left], v[left], far[left], time[left], top[left], on[left]
            f = {k: x[left] for k, x in f.items()}
            if not len(at):
                break
        mu = f["mu"]
        if t > 0:
            mu = mu * np.clip(1.0 - f["fade"] * (1.0 - np.exp(v * v * (-t / 50_000.0))), 0.5, 1.0)
        mu = mu * (1.0 + 0.01 * np.maximum(0.0, 5.0 - v))
        a = _decelerate(v, mu, f)
        moved = np.maximum(0.0, v - a * STEP_S)
        v = np.where(on, moved, v)
        top = np.where(on, np.maximum(top, a), top)
        far += np.where(on, v * STEP_S, 0.0)
        time += np.where(on, STEP_S, 0.0)
        t += STEP_S
        step += 1
    total_time = np.where(speed > 0, s["reaction_s"] + s["propagation_s"] + spent, 0.0)
    return dict(zip(RESULTS, (speed * s["reaction_s"], built_up, braking, spent, total_time, peak)))


def stopping_advisories(states: DataFrame, geometry: DataFrame, *, key: str = "row_id") -> DataFrame:
    """Advisory per train state; never shorter than the certified distance.

    ``states``: key, train_type, speed_kmh, lat, lon, vibration_rms and
    optionally humidity_pct, headwind_kmh, ambient_c. A state without
    vibration gives ``UNAVAILABLE`` and no distance.
    """
    defaults = {"humidity_pct": 50.0, "headwind_kmh": 0.0, "ambient_c": 35.0}
    for name, value in defaults.items():
        current = F.coalesce(F.col(name), F.lit(value)) if name in states.columns else F.lit(value)
        states = states.withColumn(name, current)
    placed = geometry_lookup(states, geometry).withColumn("_c", train_config(F.col("train_type")))
    ready = placed.select(
        key, "train_type", "speed_kmh", "gradient", "curve_radius", "headwind_kmh", "ambient_c",
        adhesion(F.col("speed_kmh"), F.col("vibration_rms"), F.col("humidity_pct")).alias("mu"),
        F.col("vibration_rms").isNotNull().alias("usable"),
        *[F.col(f"_c.{f}").alias(f) for f in CONFIG_FIELDS],
    )
    kept = [key, "train_type", "speed_kmh", "gradient", "curve_radius", "ambient_c", "mu", "usable"]
    numbers = ["speed_kmh", "gradient", "curve_radius", "headwind_kmh", "ambient_c", "mu", *CONFIG_FIELDS]

    def advance(batches):
        for batch in batches:
            s = {n: np.nan_to_num(batch.column(n).to_numpy(zero_copy_only=False).astype(float)) for n in numbers}
            found = stop_distances(s)
            arrays = [batch.column(k) for k in kept] + [pa.array(found[r], pa.float64()) for r in RESULTS]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + RESULTS)

    schema = ", ".join(f"{k} {ready.schema[k].dataType.simpleString()}" for k in kept)
    stepped = ready.mapInArrow(advance, schema + "".join(f", {r} double" for r in RESULTS))
    ok = F.col("usable")
    certified = certified_distance(F.col("speed_kmh"))
    total = F.col("reaction_m") + F.col("propagation_m") + F.col("braking_m")
    out = stepped.withColumns({"certified_m": F.when(ok, certified), "total_m": F.when(ok, total)})
    advised = F.greatest("total_m", "certified_m")
    return out.select(
        key, "train_type", "speed_kmh",
        F.when(ok, "KAVACH_ADVISORY").otherwise("KAVACH_ADVISORY_UNAVAILABLE").alias("alert_type"),
        F.round(F.when(ok, advised), 2).alias("advisory_m"), F.round("certified_m", 2).alias("certified_m"),
        F.when(ok, F.col("total_m") < F.col("certified_m")).alias("clamped"),
        F.when(ok, F.round((advised - F.col("certified_m")) / F.greatest("certified_m", F.lit(1.0)) * 100, 1)).alias("margin_pct"),
        F.when(ok, F.round("mu", 4)).alias("adhesion"),
        F.when(ok, F.round(brake_fade(F.col("speed_kmh"), F.col("brake_s"), F.col("ambient_c")), 3)).alias("brake_fade"),
        *[F.when(ok, F.round(r, 3)).alias(r) for r in RESULTS],
    )
