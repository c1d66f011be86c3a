"""Suppression over many chunks of one category, against a plain walk over all alerts."""

import math
import random

from permaway.operators import fold, stateful


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    half = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(half), math.sqrt(1 - half))


def test_dense_alerts_over_many_chunks(spark, monkeypatch):
    pick = random.Random(4)
    rows = [("a", i, pick.random() * 4000, 28.6 + pick.randrange(6) * 0.0003, 77.2 + pick.randrange(4) * 0.0002) for i in range(2400)]
    rows += [("a", 5000 + i, 1000.0 + i, None, 77.2) for i in range(2)]  # without a place, near nothing
    want, open_ = {}, []
    for _, i, t, lat, lon in sorted(rows, key=lambda r: (r[2], r[1])):
        near = [o for o in open_ if t - o[0] <= 600 and None not in (lat, o[2]) and metres((lat, lon), o[2:]) <= 50]
        want[i] = near[0][1] if near else i
        if not near:
            open_.append((t, i, lat, lon))
    runs = []
    whole = fold._summaries
    monkeypatch.setattr(fold, "_summaries", lambda *a: runs.append(whole(*a)) or runs[-1])
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    spark.conf.set("spark.permaway.chunks", "12")
    try:
        df = spark.createDataFrame(rows, "k string, row_id long, t double, lat double, lon double")
        got = {r.row_id: r.original for r in stateful.run(df, ["k"], stateful.suppression("k", "string")).collect()}
    finally:
        spark.conf.unset("spark.permaway.chunks")
    assert got == want
    # All chunks twice; then one chunk, and what leads on from it, in a round.
    assert len(runs[1]) == 11 and all(len(r) <= 2 for r in runs[2:])
