from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from permaway.llm import mixing

WORDS = "abc de fgh ijkl"


def fair_targets(sizes, weights, most=3):
    """By the rule as stated: cap what is above, share out the excess again, until none is above."""
    target = {k: Fraction(0) for k in sizes}
    excess, open_ = Fraction(sum(sizes.values())), set(sizes)
    while excess and open_:
        parts = sum(weights[k] for k in open_)
        for k in open_:
            target[k] += excess * weights[k] / parts
        excess = sum((target[k] - most * sizes[k] for k in open_ if target[k] > most * sizes[k]), Fraction(0))
        over = {k for k in open_ if target[k] >= most * sizes[k]}
        for k in over:
            target[k] = Fraction(min(target[k], most * sizes[k]))
        open_ -= over
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, point string, draws string")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, " ".join(WORDS.split() * (i % 7)), f"s{i % 3}") for i in range(200)]
    rows += [(1000 + i, "one two", "tiny") for i in range(2)] + [(7, None, "s1"), (None, "x y z", None), (None, "x y z", None), (8, "", "empty"), (9, "é " * 5000, "\U0001f600")]
    rows += [(5, "same again here", "s2")] * 40
    return rows


def test_quotas_and_caps(spark, odd):
    docs = frame(spark, [(*r, "x", "y", "z") for r in odd])
    mix = mixing.plan(docs, shards=5, block_words=64)
    got = mixing.mixed_sizes(mix).collect()
    assert len(got) == len(odd)
    sizes = {}
    for _, text, source in odd:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda x: (x is None, x))
    want = fair_targets(sizes, {k: i % 3 + 1 for i, k in enumerate(order)})
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    # Rows that are equal in all give alike, so up to their number of words may be left out.
    assert all(0 <= round(want[k]) - taken[k] <= (40 if k == "s2" else 1) for k in sizes)
    again = mixing.mixed_sizes(mixing.plan(docs.repartition(7), shards=5, block_words=64)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken, r.draws)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_texts_of_shards(spark, odd):
    docs = frame(spark, [(*r, "x", "y", "z") for r in odd])
    mix = mixing.plan(docs, shards=4, block_words=64)
    texts = mixing.mixed_texts(docs, mix)
    got = texts.withColumn("partition", F.spark_partition_id()).collect()
    assert all(len(r.text.split()) == r.words for r in got)
    assert len({(r.partition, r.shard) for r in got}) == len({r.shard for r in got})
    assert sum(r.words for r in got) == mixing.mixed_sizes(mix).agg(F.sum("taken")).first()[0]


def test_no_rows(spark):
    mix = mixing.plan(frame(spark, []), shards=3)
    assert mixing.mixed_sizes(mix).count() == 0 and mixing.mixed_texts(frame(spark, []), mix).count() == 0


def test_only_empty_texts(spark):
    docs = frame(spark, [(1, None, None, "", "", ""), (2, "", "a", "", "", "")])
    assert [(r.taken, r.target) for r in mixing.mixed_sizes(mixing.plan(docs)).collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("shards", [1, 2, 7, 32])
def test_tree_hands_out_every_block(spark, shards):
    quota = [0, 5, 1000, 37, 1, 0, 412]
    got = mixing.splitting_tree(spark.createDataFrame([(quota,)], "quota array<long>"), shards, 3).orderBy("shard").collect()
    assert [r.shard for r in got] == list(range(shards))
    for k, q in enumerate(quota):
        assert [r.start[k] for r in got] == [sum(r.quota[k] for r in got[:i]) for i in range(shards)]
        assert sum(r.quota[k] for r in got) == q
    edges = [i * sum(quota) // shards for i in range(shards + 1)]
    assert [sum(r.quota) for r in got] == [b - a for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("rest,marked,drawn", [(10, 4, 5), (50, 20, 30), (7, 7, 3), (9, 0, 4), (60, 3, 1), (1000, 400, 300), (5, 5, 5), (0, 0, 0)])
def test_hypergeometric_inverts_the_distribution(spark, rest, marked, drawn):
    """Evenly spaced uniform numbers give each value its share, to within one number at each end."""
    n = 4000
    sql = mixing.hypergeometric("rest", "marked", "drawn", f"((id + 0.5D) / {n})")
    rows = spark.range(n).selectExpr("id", f"{rest}L AS rest", f"{marked}L AS marked", f"{drawn}L AS drawn").selectExpr(f"{sql} AS x").groupBy("x").count().collect()
    got = {r.x: r["count"] for r in rows}
    for x in range(max(0, drawn + marked - rest), min(drawn, marked) + 1):
        want = n * comb(marked, x) * comb(rest - marked, drawn - x) / comb(rest, drawn)
        assert abs(got.pop(x, 0) - want) <= 1.001
    assert not got


def test_native_plan(spark, odd):
    docs = frame(spark, [(*r, "x", "y", "z") for r in odd])
    plan = mixing.mixed_sizes(mixing.plan(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
