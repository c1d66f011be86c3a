"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

Each match of the split pattern is a piece. Over a piece's byte positions stands a segment tree whose leaves hold the rank
of the pair that begins there, with the position in the low bits, so that the root is the leftmost pair of least rank. A
merge updates three leaves (its own, that of the part it swallows, and the left neighbour's) and their ancestors. Short
pieces of one tree size are merged side by side, one merge of each at a time; long ones alone. A worker keeps the ids of
pieces it has met, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.memo import Memo
from permaway.llm.store import list_array

NONE = np.int64(1) << np.int64(62)
#: Bits of a tree entry that hold the position; of a pair of ids, those of the second.
PLACE_BITS, ID_BITS = 32, 24
#: Bytes of the longest piece that is merged side by side with others, and pieces that are so merged at once.
SHORT, TOGETHER = 64, 16_384
#: Pieces that a worker remembers.
KNOWN = 300_000


class Vocabulary:
    """Ranks of byte strings, and the pairs of ids whose strings join to a known one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [x for x in range(256) if bytes([x]) not in ranks]:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        self.strings = {v: k for k, v in ranks.items()}
        pairs = {
            ranks[x[:i]] << ID_BITS | ranks[x[i:]]: rank for x, rank in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks
        }
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[x] for x in self.pair_keys.tolist()], np.int64)
        self.known = Memo(lambda pieces: self.encode_pieces([x.encode() for x in pieces]), KNOWN)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or -1."""
        keys = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1) if len(self.pair_keys) else np.full(len(keys), -1)

    def ids_of(self, texts: list[list[str]]) -> list[bytes]:
        """Little-endian 32-bit ids of the pieces of each text, one after the other; new pieces of all texts are merged together."""
        ids = self.known.values(set().union(*texts))
        return [b"".join(map(ids.__getitem__, x)) for x in texts]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[i] = self._merge_long(piece)
            else:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in by_size.items():
            for k in range(0, len(members), TOGETHER):
                own = members[k : k + TOGETHER]
                for i, ids in zip(own, self._merge_short([pieces[i] for i in own], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merge pieces of at most `width` bytes side by side: arrays of positions by pieces."""
        n = len(pieces)
        lengths = np.array([len(x) for x in pieces])
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width).T
        place, column = np.arange(width, dtype=np.int64)[:, None], np.arange(n)
        ids = self.byte_ids[raw]
        after = np.where(place + 1 < lengths, place + 1, width) + np.zeros((1, n), np.int64)
        before = place - 1 + np.zeros((1, n), np.int64)
        alive = place < lengths
        tree = np.full((2 * width, n), NONE, np.int64)
        rank = self.rank_of(ids[:-1].ravel(), ids[1:].ravel()).reshape(width - 1, n)
        tree[width : 2 * width - 1] = np.where((rank >= 0) & alive[1:], rank << PLACE_BITS | place[:-1], NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        while len(column := column[tree[1, column] < NONE]):
            least = tree[1, column]
            at = least & ((1 << PLACE_BITS) - 1)
            gone = after[at, column]
            right = after[gone, column]
            left = before[at, column]
            ids[at, column] = least >> PLACE_BITS
            alive[gone, column] = False
            after[at, column] = right
            has_right, has_left = right < width, left >= 0
            before[right[has_right], column[has_right]] = at[has_right]
            tree[width + gone, column] = NONE
            tree[width + at, column] = self._leaf(ids, at, right, column, has_right)
            tree[width + left[has_left], column[has_left]] = self._leaf(ids, left, at, column, has_left)[has_left]
            nodes, columns = np.concatenate([at, gone, np.where(has_left, left, at)]) + width, np.tile(column, 3)
            for _ in range(width.bit_length() - 1):
                nodes >>= 1
                tree[nodes, columns] = np.minimum(tree[2 * nodes, columns], tree[2 * nodes + 1, columns])
        flat, ends = ids.T[alive.T].astype("<i4").tobytes(), np.cumsum(alive.sum(0)) * 4
        return [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _leaf(self, ids: np.ndarray, left: np.ndarray, right: np.ndarray, column: np.ndarray, there: np.ndarray) -> np.ndarray:
        rank = self.rank_of(ids[np.where(there, left, 0), column], ids[np.where(there, right, 0), column])
        return np.where(there & (rank >= 0), rank << PLACE_BITS | left, NONE)

    def _merge_long(self, piece: bytes) -> bytes:
        n = len(piece)
        width, none = 1 << (n - 1).bit_length(), int(NONE)
        ids, after, before = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get

        def leaf(i: int) -> int:
            rank = get(ids[i] << ID_BITS | ids[after[i]]) if after[i] < n else None
            return none if rank is None else rank << PLACE_BITS | i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        dead = bytearray(n)
        while tree[1] < none:
            at = tree[1] & ((1 << PLACE_BITS) - 1)
            gone = after[at]
            ids[at], after[at], dead[gone] = tree[1] >> PLACE_BITS, after[gone], 1
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([x for x, d in zip(ids, dead, strict=True) if not d], "<i4").tobytes()


def read_ranks(path: str) -> bytes:
    """A rank file: lines of a base64 byte string and its rank."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}, pattern)


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row: each match of the pattern merged by itself, without special tokens.

    A null or empty text has no ids. Repeated rows and null ids are rows like any other; no rows give no rows.
    """
    ranks = read_ranks(ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, pattern)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + (2 << 20), side="right")))
                found = [words.pattern.findall(x or "") for x in texts[low:high].to_pylist()]
                parts = words.ids_of(found)
                values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                ids = list_array(np.cumsum([0, *(len(x) // 4 for x in parts)]), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], ids], ["doc_id", "ids"])
                low = high

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str = "") -> DataFrame:
    """df with its column ids (array<int>) replaced by decoded, the bytes they stand for; null ids stand for none.

    An id that the ranks lack raises KeyError.
    """
    ranks = read_ranks(ranks_path)
    names = [x for x in df.columns if x != "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string_of = vocabulary(ranks, pattern).strings.__getitem__
        for batch in batches:
            lists = batch.column("ids").to_numpy(zero_copy_only=False)
            for low in range(0, len(lists), 500):
                decoded = pa.array([b"" if x is None else b"".join(map(string_of, x.tolist())) for x in lists[low : low + 500]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(x)[low : low + 500] for x in names), decoded], [*names, "decoded"])

    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name != "ids"]
    return df.mapInArrow(work, ", ".join([*kinds, "decoded binary"]))
