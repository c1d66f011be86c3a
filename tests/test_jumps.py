"""The map of a chunk leads every state where its rows lead it, and maps follow one another as chunks do."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from permaway import session
from permaway.operators import fold, stateful

EVENTS = ["success", "failure", "failure", "failure", "uploaded"]
MACHINES = {
    "average": lambda: stateful.exponential_average("k", "int", 0.3),
    "average_from": lambda: stateful.exponential_average("k", "int", 0.05, start=2.0),
    "level": lambda: stateful.kalman_level("k", "int"),
    "motion": lambda: stateful.kalman_motion("k", "int"),
    "link": lambda: stateful.link_states("k", "int", window_s=4.0),
    "link_once": lambda: stateful.link_states("k", "int", threshold=1, window_s=4.0),
    "link_many": lambda: stateful.link_states("k", "int", threshold=5, window_s=9.0),
    "thermal": lambda: stateful.thermal_states("k", "int", 60.0, 5.0),
    "thermal_held": lambda: stateful.thermal_states("k", "int", 60.0, 5.0, restart_on_heat=False),
    "counter": lambda: stateful.failure_counter("k", "int"),
}


def frame(pick, n, hot):
    t = sorted(pick.choice([pick.uniform(0, 2 * n), float(pick.randint(0, 2 * n))]) for _ in range(n))
    return pd.DataFrame({
        "k": 1, "row_id": range(n), "t": t, "value": [pick.gauss(0, 5) for _ in t], "temperature": [61.0 if pick.random() < hot else 20.0 for _ in t],
        "event": pick.choices(EVENTS, [hot, 1, 1, 1, 1], k=n), "failed": [pick.random() < 1 - hot / 2 for _ in t],
    })


def near(a, b):
    return fold._near(json.loads(json.dumps(a)), json.loads(json.dumps(b)), 1e-9)


@pytest.mark.parametrize("name", list(MACHINES))
def test_maps_of_chunks(name):
    pick, machine = random.Random(name), MACHINES[name]()
    plain = lambda x: json.loads(json.dumps(x))  # noqa: E731  as states travel
    for _ in range(400):
        rows = frame(pick, pick.randint(2, 40), pick.choice([0.0, 0.1, 0.4]))
        cuts = sorted({0, len(rows), *(pick.randint(1, len(rows) - 1) for _ in range(pick.randint(1, 4)))})
        state = None
        for low, high in zip(cuts, cuts[1:]):
            part = rows.iloc[low:high]
            stepped = plain(machine.step(part, state)[1])
            if state is not None:
                summary = plain(machine.jump.build(part[machine.jump.columns], plain(machine.step(part, None)[1])))
                assert near(machine.jump.apply(summary, state), stepped)
            state = stepped


@pytest.mark.parametrize("name", list(MACHINES))
def test_one_hot_key_over_many_chunks(spark, name):
    machine = MACHINES[name]()
    rows = frame(random.Random(7), 600, 0.1)
    spark.conf.set("spark.permaway.chunks", "16")
    try:
        got = stateful.run(spark.createDataFrame(rows).repartition(5), ["k"], machine).drop("k").toPandas()
    finally:
        spark.conf.unset("spark.permaway.chunks")
    want = machine.step(rows.sort_values(machine.order), None)[0].drop(columns="k")
    columns = list(want.columns)
    got, want = (x[columns].sort_values(["row_id"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_number_of_chunks():
    sizes = [0, 1, 32 << 20, 10**12, 10**14]
    chunks = [-(-x // session.chunk_bytes(x)) for x in sizes]
    assert chunks[:3] == [0, 1, 1] and chunks[3] == session.MOST_CHUNKS and chunks[4] < 100_000
