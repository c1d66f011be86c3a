"""Scans that look ahead take each row once, and give what a plain walk gives."""

import random

from permaway.operators.scan import next_known, ordered_scan


def test_next_known_walks_backwards_once(spark):
    pick = random.Random(3)
    rows = [(k, i, pick.choice([None, None, None, i * 10])) for k in (None, 1, 2) for i in range(300)]
    out = ordered_scan(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], [next_known("v", "ahead")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    want = {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        want[k, i] = v if v is not None else want.get((k, i + 1))
    assert {(r.k, r.i): r.ahead for r in out.collect()} == want
