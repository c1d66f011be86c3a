import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from permaway.llm import packing
from permaway.llm.queries import QUERIES

MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(MODEL)


def slow_level(count, size, capacity):
    """The level with the least sum of squares, by computing each sum anew."""
    best = None
    for h in [0, *range(1, capacity - size + 1)]:
        if h and not count[h]:
            continue
        after = count.copy()
        if h:
            after[h] -= 1
        if h + size < capacity:
            after[h + size] += 1
        key = (int((after[1:capacity] ** 2).sum()), -h)
        best = min(best, key) if best else key
    return -best[1]


@pytest.mark.parametrize("seed", range(5))
def test_levels(seed):
    pick, packer = random.Random(seed), packing.Packer(32)
    for i in range(300):
        size = pick.choice([pick.randint(1, 31), pick.choice([3, 17, 20])])
        assert packer.level_for(size) == slow_level(packer.count, size, 32)
        packer.put(i, size)


def check(rows, want, capacity):
    """want: doc_id -> ids; every id in one piece, sequences gapless, no padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert all(r.doc_tokens == len(want[d]) for r in pieces) and sum(r.length for r in pieces) == len(want[d])
        for r in pieces:
            body = np.array(want[d][r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids == body if hasattr(r, "ids") else r.ids_crc32 == zlib.crc32(body)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        n = sum(r.length for r in pieces)
        assert n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    assert padding == 0


def test_texts(spark, tokenizer):
    pick = random.Random(1)
    chars = "abcde fgh \n\té'sS!?12 <|endoftext|>漢Σß́ "
    texts = [None, "", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> <|endof text|>", "word " * 5000, "x" * 3000] + ["".join(pick.choice(chars) for _ in range(pick.randint(0, 900))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for capacity in (64, 4096):
        check(packing.pack(df, MODEL, 2, capacity).collect(), want, capacity)


def test_open_windows_are_bounded():
    packer = packing.Packer(100)
    for i in range(3000):
        packer.put(i, 51)
        assert packer.n_open <= packing.OPEN_WINDOWS
    packer.finish()
    sizes = [sum(p[2] for p in w) for w in packer.take()]
    assert sum(sizes) == 3000 * 51 and all(x == 100 or x & (x - 1) == 0 for x in sizes)


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, MODEL, 2).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(df, MODEL, 2).collect()) == 6


def test_query(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(QUERIES["op8_sum_of_squares_packing"](spark, folder).collect(), want, 4096)
