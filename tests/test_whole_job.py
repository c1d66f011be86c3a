"""Queries that do the whole of an operation, against counts made another way."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from permaway.operators import signal, stateful
from permaway.plans import QUERIES
from permaway.sources import archive
from tests.conftest import DATA


def test_gap_fill_hours_fills_every_gap_to_the_limit(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet").drop_duplicates(["user_id", "ts"]).sort_values(["user_id", "ts"])
    gaps = e.groupby("user_id")["ts"].diff().dt.total_seconds().to_numpy()
    expected = int(np.minimum(np.rint(gaps[gaps > 300]) - 1, 1799).sum())
    out = QUERIES["gap_fill_hours"](spark, DATA).toPandas()
    assert out["interpolated"].sum() == expected
    assert out["rows"].sum() == expected + len(e)


def test_anomaly_evidence_holds_every_window_over_the_limit(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    wins = [(u, o // 10, g.iloc[o:o + 60]) for u, g in e.groupby("user_id") for o in range(0, len(g) - 59, 10)]

    def features(v):
        c = v - v.mean()
        return v.mean(), v.std(), (c ** 4).mean() / v.var() ** 2 - 3, (c[1:] * c[:-1] < 0).sum() / len(v)

    x = np.array([features(g["value"].to_numpy()) for _, _, g in wins])
    z = (x - x.mean(0)) / x.std(0)
    axes = np.linalg.eigh(np.cov(z.T))[1][:, -2:]
    mse = ((z - z @ axes @ axes.T) ** 2).mean(1)
    assert 0 < (mse > 0.05).sum() < len(wins)
    out = {(r["user_id"], r["win"]): r for r in QUERIES["anomaly_evidence"](spark, DATA).collect()}
    assert set(out) == {(u, w) for (u, w, _), m in zip(wins, mse) if m > 0.05}
    for (u, w, g), m in zip(wins, mse):
        if m > 0.05:
            assert abs(out[u, w]["reconstruction_error"] - m) < 1e-3
            assert [h["raw"] for h in out[u, w]["evidence"]] == [f"m{i}" for i in g["event_id"]]


def test_anomalies_are_appended_with_their_evidence(spark, tmp_path):
    scored = spark.createDataFrame([("a", 0, 0.05), ("a", 1, 0.0501), ("b", 0, float("nan")), ("b", 1, None)], "src string, win bigint, mse double")
    kept = spark.createDataFrame([(k, w, [(f"{k}{w}",)] * 60) for k in "ab" for w in (0, 1)], "src string, win bigint, evidence array<struct<raw:string>>")
    found = signal.window_anomalies(scored, kept, ["src"])
    for _ in range(2):
        archive.append_anomalies(found, str(tmp_path), "Zone-2", F.lit("north"), F.lit("2024-01-01").cast("timestamp"))
    rows = archive.read_archive(spark, "security_anomaly", str(tmp_path)).collect()
    held = spark.read.parquet(f"{tmp_path}/forensic_evidence").collect()
    assert [r["reconstruction_error"] for r in rows] == [0.0501] * 2 and {r["forensic_artifact_id"] for r in rows} == {h["alert_id"] for h in held}
    assert [[m["raw"] for m in h["evidence"]] for h in held] == [["a1"] * 60] * 2


def test_signal_pipeline_counts_transients(spark):
    df = spark.createDataFrame([("s", float(i), i, 100.0 if i == 21 else float(i % 2)) for i in range(64)], "sensor string, t double, row_id bigint, value double")
    out = {r["win"]: r for r in signal.window_pipeline(df, "sensor", "string", size=32).collect()}
    filtered = [r["filtered"] for r in stateful.run(df, ["sensor"], stateful.kalman_level("sensor", "string")).orderBy("t").collect()]
    for win in (0, 1):
        approx, expected = np.array(filtered[win * 32:win * 32 + 32]), 0
        for _ in range(3):
            detail, approx = (approx[::2] - approx[1::2]) / 2 ** 0.5, (approx[::2] + approx[1::2]) / 2 ** 0.5
            expected += int((np.abs(detail) > 4 * np.abs(detail).mean()).sum())
        assert out[win]["wavelet_transient_count"] == expected
    assert out[0]["wavelet_transient_count"] > 0
    short = spark.createDataFrame([([0.0] * 7,), ([0.0] * 8,)], "samples array<double>")
    assert [r["wavelet_transient_count"] for r in signal.transient_count(short).collect()] == [None, 0]


def test_scaling_actions_keep_their_distance(spark):
    advice = ["UP", "DOWN", "NONE", "UP", "UP", "UP", "UP", "UP", "UP", "UP", "UP", "UP", "NONE", "DOWN"]
    active = [0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame(list(zip(range(14), active, advice)), "tick bigint, active bigint, advice string")
    last, expected = None, []
    for i, (n, a) in enumerate(zip(active, advice)):
        free = last is None or 30 * i - last >= 120
        expected.append(a if free else "NONE")
        last = 30 * i if free and n and a != "NONE" else last
    out = stateful.scaling_actions(df, "tick", F.col("tick") * 30).orderBy("tick").collect()
    assert [r["advice"] for r in out] == expected
    assert expected.count("NONE") > advice.count("NONE")


def test_top3_of_all_entries_ranks_whole_embeddings(spark):
    v = pd.read_parquet(f"{DATA}/embeddings.parquet")
    expected = {(i, r + 1, f"f{f}") for i, e in zip(v["vec_id"], v["embedding"]) for r, f in enumerate(np.argsort(-np.abs(np.asarray(e, float)), kind="stable")[:3])}
    out = QUERIES["top3_of_all_entries"](spark, DATA).collect()
    assert {(r["vec_id"], r["rank"], r["feature"]) for r in out} == expected
    assert any(int(r["feature"][1:]) >= 8 for r in out)
