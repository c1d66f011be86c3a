import random

import duckdb
import pytest

from permaway.llm import hamming
from permaway.llm.queries import ORACLES, QUERIES


def brute_force(rows, queries, k):
    least = {}
    for i, c in rows:
        if i is not None and c is not None:
            least[i] = min(c, least.get(i, c))
    asked = {}
    for i, c in queries:
        if i is not None and c is not None:
            asked[i] = min(c, asked.get(i, c))
    out = []
    for q, c in asked.items():
        near = sorted((bin((c ^ x) & (1 << 64) - 1).count("1"), i) for i, x in least.items() if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_random_codes(spark, k):
    pick = random.Random(k)
    base = [pick.getrandbits(64) for _ in range(8)]
    codes = [pick.choice(base) for _ in range(60)]
    for i in range(30):
        for _ in range(pick.randint(0, 9)):
            codes[i] ^= 1 << pick.randrange(64)
    codes += [pick.getrandbits(64) for _ in range(40)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)] + [(None, 5), (500, None), (3, 77), (3, 77), (7, -1)]
    queries = [*rows[::9], (3, 77), (900, 0), (900, 0), (None, 4)]
    make = lambda x: spark.createDataFrame([(*r, 1) for r in x], "id long, code long, distance int")
    got = sorted(map(tuple, hamming.nearest(make(rows), make(queries), k).collect()))
    assert got == brute_force(rows, queries, k)


def test_few_and_no_rows(spark):
    make = lambda x: spark.createDataFrame(x, "id long, code long")
    assert [tuple(r) for r in hamming.nearest(make([(1, 0), (2, -1)]), make([(1, 0)]), 5).collect()] == [(1, 1, 2, 64)]
    assert hamming.nearest(make([]), make([(1, 0)]), 5).count() == 0
    assert hamming.nearest(make([(1, 0)]), make([]), 5).count() == 0


def test_sign_code(spark):
    rows = [(1, [1.0] + [0.0] * 62 + [2.0]), (2, None), (3, [-1.0, 3.0, None]), (4, [1.0] * 70)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [r[0] for r in df.orderBy("id").select(hamming.sign_code("v")).collect()] == [1 - (1 << 63), None, 2, -1]


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.execute(ORACLES["op7_multi_index_hashing"]).fetchall())
    got = QUERIES["op7_multi_index_hashing"](spark, folder).select("query_id", "rank", "neighbor_id", "distance").collect()
    assert sorted(map(tuple, got)) == want
