import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from permaway.llm import alignment
from permaway.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a ", "a  ", "\n", "x\n y\t z", "two  spaces   three", "the same words the same words", "it's we'll don't 12345 67,89",
    "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café ñandú", "é e", "x▁y", "▁", "日本語のテキスト と 空白", "　wide　 space  nb", "  a", "a  b",
    "emoji 👩‍👩‍👧 🇩🇪 ok", "z" * 300 + " " + "日本" * 200, "tab\tand\r\nline\x0bfeed\x1c \x85 end", "a\x00b \x01", "word " * 3000, "ＡＢ ﬁ ½", "\n\n \n  a", "trailing newline \n",
]


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


def plain(both, texts):
    """The contract, token by token over whole texts."""
    a_model, b_model = both
    alphabet = alignment.byte_alphabet()
    rows, held = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        a_bytes = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            rows.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, begin = [], 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            groups.append(([i for i, e in zip(a, a_ends) if begin < e <= cut], [i for i, e in zip(b, b_ends) if begin < e <= cut]))
            begin = cut
        links = [(i, j) for x, y in groups for i in x for j in y]
        held.update(set(links))
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def numbers(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 20, 0])
def test_odd_texts(spark, both, head):
    """Also where workers hold few pairs or none, and the others are joined."""
    ids = [*range(len(ODD)), 3, None]
    texts = [*ODD, "again the same", "again the same"]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, pair string")
    got = alignment.align(docs, A, B, groups=True, head=head).collect()
    want = plain(both, texts)
    assert sorted((str(r.doc_id), numbers(r)) for r in got) == sorted((str(i), w) for i, w in zip(ids, want))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.n_a)
    assert sum(r.n_a > 0 for r in got) > 15


def test_query_against_plain_alignment(spark, both):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain(both, [r.text for r in rows])))
    got = QUERIES["op11_tokenizer_alignment"](spark, FOLDER).collect()
    assert len(got) == len(rows) and all(numbers(r) == want[r.doc_id] for r in got)


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@pytest.mark.parametrize("n,part_bits", [(0, 0), (1, 0), (5000, 0), (20000, 3)])
def test_perfect_hash(n, part_bits):
    pick = np.random.default_rng(n)
    keys = np.unique(pick.integers(0, 1 << 33, n))
    part = alignment.marks(keys) >> (alignment.MARK_BITS - part_bits)
    parts = [(p, *alignment.perfect_hash(keys[part == p])) for p in range(1 << part_bits) if (part == p).any()]
    hashed = alignment.PerfectHash(part_bits, parts)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(pick.integers(0, 1 << 33, 1000), keys)
    assert (hashed.index(others) == -1).all()


def test_vectors_are_summed_along_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    pairs = np.arange(50)
    rows = [(salt, int(m), int(p), int(p) + salt) for salt in range(5) for p, m in zip(pairs, alignment.marks(pairs)) if (p + salt) % 3]
    partial = spark.createDataFrame(rows, "salt int, mark int, pair long, docs long")
    parts = alignment.hashed_parts(partial.select("mark", "pair").distinct(), 1)
    counts = alignment.dense_counts(partial, parts, 1, 5)
    got = {r.pair: r["count"] for r in alignment._pair_counts(parts, counts).collect()}
    want = Counter()
    for _, _, p, n in rows:
        want[p] += n
    assert got == dict(want)
