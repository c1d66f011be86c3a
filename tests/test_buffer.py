"""The buffer with acknowledgements against a plain list, over one hot key cut into chunks."""

import random

from permaway.operators import stateful


def plain(rows, size):
    held, out, log = [], {}, []
    for t, row_id, kind, event_id, ts in sorted(rows):
        evicted = None
        if kind == "ack":
            there = [x for x in held if x[3] == event_id]
            held = [x for x in held if x[3] != event_id]
            outcome = "acked" if there else "unknown"
        else:
            if len(held) >= size:
                oldest = min(held)
                evicted = oldest[3]
                log.append((evicted, t))
                held.remove(oldest)
            outcome = "ignored" if any(x[3] == event_id for x in held) else "stored"
            if outcome == "stored":
                held.append((ts, t, row_id, event_id))
        out[row_id] = (outcome, evicted, len(held))
    return out, sorted(log)


def test_writes_acks_and_evictions(spark):
    pick = random.Random(3)
    rows = []
    for i in range(500):
        event = f"e{pick.randint(0, 250)}"
        rows.append((float(pick.randint(0, 900)), i, pick.choice(["write", "write", "ack"]), event, float(pick.randint(0, 40))))
    want, log = plain(rows, 6)
    df = spark.createDataFrame([("n", *r) for r in rows], "node string, t double, row_id bigint, kind string, event_id string, ts double").repartition(5)
    spark.conf.set("spark.permaway.chunks", "6")
    try:
        found = stateful.run(df, ["node"], stateful.acknowledged_buffer("node", "string", "string", size=6))
        got = {r.row_id: (r.outcome, r.evicted, r.pending) for r in found.collect()}
        evicted = sorted((r.event_id, r.evicted_at) for r in stateful.overflow_log(found, "node").collect())
    finally:
        spark.conf.unset("spark.permaway.chunks")
    assert got == want and evicted == log and len(log) > 20
