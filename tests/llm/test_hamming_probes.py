import random

import pytest

from permaway.llm import hamming
from tests.llm.test_hamming import brute_force


def signed(code):
    return code - (1 << 64) if code >> 63 else code


def some_codes(n):
    """Random codes, and as many near copies of them."""
    pick = random.Random(n)
    base = [pick.getrandbits(64) for _ in range(n)]
    near = [c ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 12))) for c in base]
    return [(i, signed(c)) for i, c in enumerate(base + near)]


@pytest.fixture
def written(monkeypatch):
    """Names and plans of the tables that a search writes."""
    plans, table = [], hamming.Scratch.table

    def noted(self, df, name):
        plans.append((name, df._jdf.queryExecution()))
        return table(self, df, name)

    monkeypatch.setattr(hamming.Scratch, "table", noted)
    return plans


def test_probes_are_not_broadcast(spark, written):
    rows = spark.createDataFrame(some_codes(200), "id long, code long")
    hamming.nearest(rows, rows.where("id % 5 = 0"), 3).count()
    joins = [plan.executedPlan().toString() for name, plan in written if name == "op7-best"]
    assert joins
    for plan in joins:
        assert "Join" in plan and "Broadcast" not in plan, plan


@pytest.mark.parametrize("codes_a_value, task_values", [(1, 100), (4, 1 << 19), (64, 7)])
def test_segments_of_any_width(spark, monkeypatch, codes_a_value, task_values):
    monkeypatch.setattr(hamming, "CODES_A_VALUE", codes_a_value, raising=False)
    monkeypatch.setattr(hamming, "TASK_VALUES", task_values, raising=False)
    rows = some_codes(100)
    queries = rows[::7] + [(1000, 0), (1001, -1)]
    make = lambda x: spark.createDataFrame(x, "id long, code long")
    got = sorted(map(tuple, hamming.nearest(make(rows), make(queries), 6).collect()))
    assert got == brute_force(rows, queries, 6)


def test_a_code_is_met_once(spark):
    rows = some_codes(40)
    segments = hamming._segments(5)
    make = lambda x, kind: spark.createDataFrame(x, kind)
    kept = [hamming._key(hamming.F.col("code"), j, *x) for j, x in enumerate(segments)]
    index = make([(c, [i]) for i, c in rows], "code long, ids array<long>").select("code", "ids", hamming.F.explode(hamming.F.array(*kept)).alias("key"))
    open_ = make([(c, 30) for _, c in rows[::9]], "query long, bound int")
    met = [(r.query, r.ids[0], r.distance) for radius in range(7) for r in hamming._met(open_, 9, index, segments, radius).collect()]
    far = {(q, i): bin((q ^ c) & (1 << 64) - 1).count("1") for _, q in rows[::9] for i, c in rows}
    assert sorted(met) == sorted((q, i, d) for (q, i), d in far.items() if d <= 30)


def test_masks_are_one_literal(spark):
    df = spark.range(1).select(hamming._masks(16, 8).alias("m"))
    assert sorted(df.first().m) == [x for x in range(1 << 16) if x.bit_count() == 8]
    assert df._jdf.queryExecution().analyzed().expressions().apply(0).collectLeaves().size() < 10
