"""Ordered scans and folds give the same rows whether or not a key is cut into chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permaway.operators import stateful
from permaway.operators.fold import ordered_fold
from permaway.operators.scan import (
    earlier_max, following, grouped_quantiles, last_known, next_known, ordered_scan, previous, row_number, running_max,
    running_min, running_sum, total,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 60, n).astype(str))
    pdf = pd.DataFrame({"key": key, "t": rng.integers(0, 5000, n).astype(float), "row_id": np.arange(n), "value": rng.normal(50, 20, n).round(2)})
    pdf.loc[pdf["key"] == "7", "key"] = None
    return spark.createDataFrame(pdf).cache()


def all_scans():
    return [
        previous("value", "a"), following("value", "b"), running_sum(F.col("row_id"), "c"), running_max("value", "d"), running_min("value", "e"),
        last_known(F.when(F.col("value") > 60, F.col("value")), "f"), next_known(F.when(F.col("value") > 60, F.col("value")), "g"),
        row_number("h"), total(F.lit(1), "i"), earlier_max("value", "j"),
    ]


@pytest.fixture
def chunks(spark):
    """Sets the number of chunks for the time of the test."""
    yield lambda n: spark.conf.set("spark.permaway.chunks", str(n))
    spark.conf.unset("spark.permaway.chunks")


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("descending", [False, True])
def test_chunks_do_not_change_a_scan(skewed, keys, descending, chunks):
    frames = []
    for n in (1, 7):
        chunks(n)
        out = ordered_scan(skewed, keys, ["t", "row_id"], all_scans(), descending=descending).toPandas()
        frames.append(out.sort_values("row_id").reset_index(drop=True))
    pd.testing.assert_frame_equal(*frames)


def test_chunks_grow_with_the_input(spark, tmp_path, monkeypatch):
    from permaway import session

    spark.range(200_000).withColumn("x", F.rand(1)).write.parquet(f"{tmp_path}/x")
    monkeypatch.setattr(session, "CHUNK_BYTES", 100_000)
    assert session.chunk_count(spark.read.parquet(f"{tmp_path}/x")) > 10


def test_scan_against_pandas(skewed):
    got = ordered_scan(skewed, ["key"], ["t", "row_id"], [previous("value", "p"), running_max("value", "m")]).toPandas()
    pdf = got.sort_values(["t", "row_id"])
    groups = pdf.groupby("key", dropna=False)["value"]
    np.testing.assert_array_equal(pdf["p"], groups.shift())
    np.testing.assert_array_equal(pdf["m"], groups.cummax())


def test_row_order_and_partitions_do_not_matter(skewed):
    scans = [running_sum("row_id", "s")]
    a = ordered_scan(skewed.orderBy(F.rand(1)).repartition(7), ["key"], ["t", "row_id"], scans).toPandas()
    b = ordered_scan(skewed.repartition(2), ["key"], ["t", "row_id"], scans).toPandas()
    key = lambda d: d.sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(key(a), key(b))


@pytest.mark.parametrize("keys", [["key"], []])
def test_quantiles_are_exact(skewed, keys):
    pdf = skewed.toPandas()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = grouped_quantiles(skewed, keys, "value", probs).collect()
    groups = {None: pdf["value"]} if not keys else {k: g["value"] for k, g in pdf.fillna("none").groupby("key")}
    assert len(rows) == len(groups)
    for r in rows:
        expected = groups[None] if not keys else groups[r["key"] or "none"]
        np.testing.assert_allclose(r["quantiles"], np.quantile(expected, probs))
        assert r["n"] == len(expected)


def _machines():
    yield "cooldown", stateful.cooldown("key", "string", 100.0), None
    yield "average", stateful.exponential_average("key", "string", 0.3), None
    yield "kalman", stateful.kalman_level("key", "string"), None
    yield "motion", stateful.kalman_motion("key", "string"), None
    yield "failures", stateful.failure_counter("key", "string"), {"failed": F.col("value") > 45}
    yield "thermal", stateful.thermal_states("key", "string", 70.0, 30.0), {"temperature": F.col("value")}
    yield "silence", stateful.silence_alerts("key", "string", 20.0), None
    yield "link", stateful.link_states("key", "string"), {
        "event": F.when(F.col("value") > 50, "failure").when(F.col("value") > 35, "success").otherwise("uploaded")
    }
    yield "suppression", stateful.suppression("key", "string", window_s=200.0), {
        "lat": 28 + F.col("row_id") % 9 * 0.0003, "lon": 77 + F.col("row_id") % 4 * 0.0003
    }
    yield "windows", stateful.feature_windows("key", "string", ["value"], size=20, longest_gap_s=60.0), None
    yield "anomalies", stateful.adaptive_anomalies("key", "string"), {
        "n": F.lit(100), "mean": F.col("value"), "max_delta": F.col("value") * 2, "spread": F.lit(1.0), "recent_delta": F.col("value") / 3
    }


@pytest.mark.parametrize(
    "name", ["cooldown", "average", "kalman", "motion", "failures", "thermal", "silence", "link", "suppression", "windows", "anomalies"]
)
def test_chunks_do_not_change_a_fold(skewed, name, chunks):
    machine, extra = {n: (m, e) for n, m, e in _machines()}[name]
    df = skewed.na.fill({"key": "none"}).withColumns(extra) if extra else skewed.na.fill({"key": "none"})
    frames = []
    for n in (1, 7):
        chunks(n)
        out = stateful.run(df, ["key"], machine).toPandas()
        frames.append(out.sort_values([c for c in out.columns if out[c].dtype != float] + [c for c in out.columns if out[c].dtype == float]).reset_index(drop=True))
    assert len(frames[0])
    pd.testing.assert_frame_equal(*frames, rtol=1e-9)


def test_fold_streams_a_group_in_batches(spark, skewed):
    """A step sees a key in several pieces when the group is larger than an Arrow batch."""
    def step(pdf, state):
        return pd.DataFrame({"rows": [len(pdf)], "before": [state or 0]}), (state or 0) + len(pdf)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        out = ordered_fold(skewed.filter("key = 'hot'"), ["key"], ["t", "row_id"], step, "rows bigint, before bigint").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) > 1 and out["rows"].max() <= 200
    assert (out["rows"] + out["before"]).max() == skewed.filter("key = 'hot'").count()
