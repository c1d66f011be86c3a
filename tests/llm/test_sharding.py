import random
import zlib

import pytest

from permaway.llm import sharding


def slow_best_fit(sizes, capacity):
    room, out = [], []
    for x in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= x]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(max(capacity, x))
        room[i] -= x
        out.append(i)
    return out, len(room)


@pytest.mark.parametrize("seed", range(20))
def test_tree_gives_the_bins_of_a_plain_search(seed):
    pick = random.Random(seed)
    sizes = sorted((pick.randint(1, 60) for _ in range(pick.randint(0, 200))), reverse=True)
    assert sharding.best_fit_decreasing(sizes, 50) == slow_best_fit(sizes, 50)


def test_shards_are_near_equal():
    pick = random.Random(1)
    sizes = sorted((pick.randint(1, 1000) for _ in range(5000)), reverse=True)
    bins = sharding.fewest_bytes(sizes, 24)
    load = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(24)]
    assert max(load) - min(load) < 0.02 * max(load)
    assert sharding.fewest_bytes([], 3) == [] and sharding.fewest_bytes([7], 3) == [0]


def test_rows(spark):
    big = "x" * 5000
    rows = [(1, "a"), (2, None), (3, ""), (4, big), (4, big), (None, "a"), (7, "é")] + [(i, f"w{i}" * (i % 9)) for i in range(20, 200)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, size int, shard string")
    got = sharding.shard_by_bytes(df, 4).collect()
    assert len(got) == len(rows)
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for r in got:
        body = (text[r.doc_id] or "").encode()
        assert r.size == len(body) + 8 and r.text_crc32 == zlib.crc32(body)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    groups = {}
    for r in got:
        groups.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(len(x) == 1 for x in groups.values())
    load = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert load.count(10016) == 1 and max(x for x in load if x != 10016) - min(load) <= 64


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_bytes(df, 4).count() == 0
