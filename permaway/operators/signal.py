"""Spectral, wavelet and envelope features of sample windows, and window scoring.

A window is one row with its samples as an array; stack_windows builds it from
numbered samples, so an array never exceeds the window size. Wavelets are array
expressions in the JVM; the Fourier parts run on whole Arrow batches of windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.functions.arrays import haar_step
from permaway.functions.scalars import hashed_number
from permaway.operators.ordered import tumbling_windows
from permaway.operators.stateful import kalman_level, run

# Bands of the usual defects in Hz (fixed values).
BANDS = [(0, 50), (50, 200), (200, 1000), (1000, 2000)]


def stack_windows(df: DataFrame, keys: list[str], value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per window with ``samples`` in order; a group is at most one window of samples."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("samples"))


def _padded(samples: list[np.ndarray]) -> np.ndarray:
    size = 1 << max(0, int(np.ceil(np.log2(max(len(samples[0]), 1)))))
    out = np.zeros((len(samples), size))
    out[:, : len(samples[0])] = np.stack(samples)
    return out


def _power(block: np.ndarray) -> np.ndarray:
    """Linear power of the positive bins without Nyquist, floored at 1e-12."""
    half = block.shape[1] // 2
    return np.abs(np.fft.rfft(block, axis=1)[:, :half]) ** 2 + 1e-12


def _spectral(block: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    power = _power(block)
    n, half = block.shape[1], power.shape[1]
    freqs = np.arange(half) * rate / n
    rows = np.arange(len(block))
    peak = 1 + np.argmax(power[:, 1:], axis=1) if half > 1 else np.zeros(len(block), dtype=int)
    total = power.sum(axis=1)
    weighted = (power * freqs).sum(axis=1)
    out = {
        "dominant_hz": freqs[peak],
        "dominant_db": 10 * np.log10(power[rows, peak]),
        "centroid_hz": np.where(total < 1e-12, 0.0, weighted / np.maximum(total, 1e-300)),
    }
    for low, high in BANDS:
        inside = (freqs >= low) & (freqs <= high)
        energy = 10 * np.log10(power[:, inside].sum(axis=1) + 1e-12) if inside.any() else np.full(len(block), -120.0)
        out[f"band_{low}_{high}_db"] = energy
    return out


def _envelope(block: np.ndarray, length: int) -> np.ndarray:
    n = block.shape[1]
    spectrum = np.fft.fft(block, axis=1)
    spectrum[:, n // 2 + 1:] = 0
    spectrum[:, 1:n // 2] *= 2
    return np.abs(np.fft.ifft(spectrum, axis=1))[:, :length]


SPECTRAL_FIELDS = ["dominant_hz", "dominant_db", "centroid_hz"] + [f"band_{lo}_{hi}_db" for lo, hi in BANDS]


def _by_length(df: DataFrame, compute: Callable[[list[np.ndarray]], dict[str, np.ndarray]], fields: list[str], least: int) -> DataFrame:
    """Run ``compute`` on the windows of each Arrow batch, stacked by equal length."""
    def transform(batches):
        for batch in batches:
            samples = [np.asarray(s, dtype=float) for s in batch.column("samples").to_pylist()]
            out = {f: np.full(len(samples), np.nan) for f in fields}
            lengths = np.array([len(s) for s in samples])
            for length in np.unique(lengths[lengths >= least]):
                at = np.flatnonzero(lengths == length)
                for name, values in compute([samples[i] for i in at]).items():
                    out[name][at] = values
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays = [pa.array(out[f], pa.float64(), from_pandas=True) for f in fields]
            yield pa.RecordBatch.from_arrays(kept + arrays, names=batch.schema.names[:-1] + fields)

    ids = [c for c in df.columns if c != "samples"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ids).schema)
    return df.select(*ids, "samples").mapInArrow(transform, schema + "".join(f", {f} double" for f in fields))


def spectral_features(windows: DataFrame, rate_hz: float = 4000.0, least: int = 4) -> DataFrame:
    """Dominant bin (without the constant part), centroid and band energies; null under ``least`` samples."""
    return _by_length(windows, lambda s: _spectral(_padded(s), rate_hz), SPECTRAL_FIELDS, least)


def envelope_features(windows: DataFrame, rate_hz: float = 4000.0, least: int = 16) -> DataFrame:
    """Dominant frequency of the amplitude envelope."""
    def compute(samples):
        envelope = _envelope(_padded(samples), len(samples[0]))
        found = _spectral(_padded(list(envelope)), rate_hz)
        return {"envelope_hz": found["dominant_hz"], "envelope_db": found["dominant_db"]}

    return _by_length(windows, compute, ["envelope_hz", "envelope_db"], least)


def wavelet_levels(windows: DataFrame, levels: int = 3) -> DataFrame:
    """Add ``detail_1..levels`` and ``approx`` arrays of the Haar transform."""
    out = windows.withColumn("approx", F.col("samples"))
    for level in range(1, levels + 1):
        out = out.withColumn("_w", haar_step(F.col("approx"))).withColumns(
            {f"detail_{level}": F.col("_w.detail"), "approx": F.col("_w.approx")}
        )
    return out.drop("_w")


def _mean_square(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, c: acc + c * c)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def wavelet_energy(windows: DataFrame, levels: int = 3) -> DataFrame:
    """Mean square per wavelet level and of the rest."""
    out = wavelet_levels(windows, levels)
    names = [f"detail_{i}" for i in range(1, levels + 1)]
    out = out.withColumns({f"{n}_energy": _mean_square(F.col(n)) for n in names} | {"approx_energy": _mean_square(F.col("approx"))})
    return out.drop("samples", "approx", *names)


def _transients(factor: float, levels: int) -> Column:
    """The transients in ``detail_1..levels``, as one list."""
    hits = []
    for level in range(1, levels + 1):
        d = F.col(f"detail_{level}")
        limit = F.aggregate(d, F.lit(0.0), lambda acc, c: acc + F.abs(c)) / F.size(d) * factor
        marked = F.transform(
            d, lambda c, i: F.struct(F.lit(level).alias("level"), i.alias("position"), F.abs(c).alias("magnitude"), limit.alias("threshold"))
        )
        hits.append(F.when(F.size(d) > 0, F.filter(marked, lambda h: h["magnitude"] > h["threshold"])).otherwise(F.filter(marked, lambda h: F.lit(False))))
    return F.flatten(F.array(*hits))


def wavelet_transients(windows: DataFrame, factor: float = 4.0, levels: int = 3) -> DataFrame:
    """Detail coefficients over ``factor`` times the mean magnitude of their level, one row each."""
    out = wavelet_levels(windows, levels)
    ids = [c for c in windows.columns if c != "samples"]
    return out.select(*ids, F.explode(_transients(factor, levels)).alias("_h")).select(
        *ids, "_h.*", (F.col("_h.magnitude") / F.col("_h.threshold")).alias("ratio")
    )


def transient_count(windows: DataFrame, factor: float = 4.0, levels: int = 3, least: int = 8) -> DataFrame:
    """Add ``wavelet_transient_count``; null under ``least`` samples."""
    out = wavelet_levels(windows, levels)
    count = F.when(F.size("samples") >= least, F.size(_transients(factor, levels)))
    return out.select(*windows.columns, count.alias("wavelet_transient_count"))


def window_pipeline(
    df: DataFrame, sensor: str, sensor_type: str, *, size: int = 512, rate_hz: float = 4000.0,
    levels: int = 4, envelope: bool = False,
) -> DataFrame:
    """Samples (sensor, t, row_id, value) to window features: smooth, stack, spectrum, wavelet with transients, envelope."""
    smooth = run(df, [sensor], kalman_level(sensor, sensor_type))
    numbered = tumbling_windows(smooth, [sensor], ["t", "row_id"], size)
    windows = stack_windows(numbered, [sensor, "win"], "filtered")
    x = F.col("samples")
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    described = windows.withColumn("mean", mean).withColumns(
        {
            "rms": F.sqrt(_mean_square(x)),
            "std": F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - F.col("mean"), 2)) / n),
            "low": F.array_min(x), "high": F.array_max(x),
        }
    )
    ids = [sensor, "win", "mean", "rms", "std", "low", "high"]
    spectral = spectral_features(described.select(*ids, "samples", F.struct("samples").alias("_keep")), rate_hz)
    back = spectral.withColumn("samples", F.col("_keep.samples")).drop("_keep")
    out = wavelet_levels(transient_count(back), levels)
    names = [f"detail_{i}" for i in range(1, levels + 1)]
    out = out.withColumns({f"{d}_energy": _mean_square(F.col(d)) for d in names} | {"approx_energy": _mean_square(F.col("approx"))})
    out = out.drop("approx", *names)
    if envelope:
        return envelope_features(out.select(*[c for c in out.columns if c != "samples"], "samples"), rate_hz)
    return out.drop("samples")


def logistic_scorer(train: DataFrame, columns: list[str], label: str):
    """Default scorer: a Spark ML logistic regression; returns ``df -> df`` adding ``p``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [
        VectorAssembler(inputCols=columns, outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_s", withMean=True),
        LogisticRegression(featuresCol="_s", labelCol=label, probabilityCol="_p", maxIter=50),
    ]
    model = Pipeline(stages=stages).fit(train)

    def apply(df: DataFrame) -> DataFrame:
        scored = model.transform(df).withColumn("p", F.get(vector_to_array("_p"), 1))
        return scored.select(*df.columns, "p")

    return apply


def reconstruction_scorer(train: DataFrame, columns: list[str], k: int = 2):
    """Default autoencoder stand-in: mean squared error after projection on ``k`` principal axes.

    The fitted axes are a small matrix (columns x k), so scoring is plain column arithmetic.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    stats = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}") for c in columns]
    ).first()
    unit = lambda c: (F.col(c) - float(stats[f"m_{c}"])) / float(stats[f"s_{c}"] or 1.0)
    scaled = train.select(*[unit(c).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(scaled)
    axes = PCA(k=k, inputCol="_v", outputCol="_z").fit(vectors).pc.toArray()

    def apply(df: DataFrame) -> DataFrame:
        x = [unit(c) for c in columns]
        z = [sum((x[i] * float(axes[i, j]) for i in range(1, len(x))), x[0] * float(axes[0, j])) for j in range(k)]
        wide = df.withColumns({f"_z{j}": z[j] for j in range(k)})
        error = F.lit(0.0)
        for i in range(len(columns)):
            again = F.lit(0.0)
            for j in range(k):
                again = again + F.col(f"_z{j}") * float(axes[i, j])
            error = error + F.pow(x[i] - again, 2)
        return wide.withColumn("mse", error / len(columns)).drop(*[f"_z{j}" for j in range(k)])

    return apply


def window_anomalies(scored: DataFrame, evidence: DataFrame, keys: list[str], *, threshold: float = 0.05) -> DataFrame:
    """Windows whose ``mse`` is over ``threshold``, each with the raw rows that it was made of.

    ``scored`` holds (keys, win, mse), ``evidence`` the rows of ``ordered.window_evidence``. The id is hashed from the
    window's keys, so a retry gives the same id. An error that is null or not a number is no anomaly.
    """
    name = F.sha2(F.concat_ws("|", *[F.coalesce(F.to_json(F.struct(k)), F.lit("")) for k in [*keys, "win"]]), 256)
    over = scored.filter(~F.isnan("mse") & (F.col("mse") > threshold))
    return over.select(*keys, "win", "mse").join(evidence, [*keys, "win"]).select(
        name.alias("alert_id"), *keys, "win", F.lit("SECURITY_ANOMALY").alias("alert_type"),
        F.round("mse", 6).alias("reconstruction_error"), F.lit(threshold).alias("threshold"), F.lit(False).alias("acknowledged"), "evidence",
    )


def canary_version(request_id: Column, weights: dict[str, float], parts: int = 10_000) -> Column:
    """Model version of a request by traffic weight; the same request always takes the same version."""
    total, upto = sum(weights.values()), 0.0
    place = hashed_number(request_id) % parts
    out = F.lit(None).cast("string")
    for name, share in reversed(list(weights.items())):
        out = F.when(place < F.lit(sum(list(weights.values())[: list(weights).index(name) + 1]) / total * parts), F.lit(name)).otherwise(out)
    return out


def missing_labels(images: DataFrame, labels: DataFrame, class_index: Column) -> DataFrame:
    """Default label rows for images (class, stem) that have none."""
    from permaway.functions.scalars import default_label

    return images.join(labels.select("class", "stem"), ["class", "stem"], "left_anti").withColumn(
        "label", default_label(class_index)
    )
