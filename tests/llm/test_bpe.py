import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from permaway.llm import bpe
from permaway.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    pick = random.Random(2)
    chars = "abcdefgh  \n\t'sdß漢字é😀Ω٣!?.,-_<|endoftext|>　́"
    out = [None, "", " ", "a", "it's  'S we'll\n\n x", "<|endoftext|>", "a" * 5000, "漢" * 700 + "x", "the" * 40, "!" * 300]
    out += ["".join(pick.choice(chars) for _ in range(pick.randint(0, 120))) for _ in range(300)]
    return out + ["".join(pick.choice("abcdefghij") for _ in range(n)) for n in (63, 64, 65, 66, 127, 3000)]


def test_ids_are_those_of_the_public_library(spark, public):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    for i, t in rows:
        assert got[i] == public.encode_ordinary(t or ""), t
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    df = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(df, RANKS).first().decoded) == b""


def test_memory_of_pieces_is_bounded(public, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 10)
    words = bpe.Vocabulary(public._mergeable_ranks, public_tokenizers.PATTERN)
    for t in texts():
        words.ids_of([words.pattern.findall(t or "")])
    (fresh,) = words.ids_of([words.pattern.findall("some words again")])
    assert list(memoryview(fresh).cast("i")) == public.encode_ordinary("some words again") and len(words.known.young) + len(words.known.old) <= 120


def test_query(spark, public):
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = public.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op10_byte_bpe"](spark, folder).collect())) == sorted(want)
