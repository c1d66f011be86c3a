"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked id pairs.

Texts are encoded once, and the ids written down. The first pass over them aligns the texts and finds the pairs; a minimal perfect
hash is built over the distinct pairs, in parts that tasks build side by side. Counts are dense vectors indexed by that
hash, one for each part and some tasks, and summed along a tree. The second pass aligns the texts again and looks counts
up; the key that stands at an index is compared.

Tokens of both kinds end where a space follows anything but white space, so texts are cut there into chunks, and each chunk that
some texts hold is encoded once for all of them.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.memo import Memo
from permaway.llm.store import Scratch, list_array, text_of
from permaway.llm.words import mix, slices, text_bytes

#: Pairs that workers hold for look-ups: the most frequent ones; the others are looked up by a join.
HEAD_PAIRS = 1 << 21
#: Pairs of one part of the hash, about; tasks whose counts are added to one vector; counts a task holds before it puts them out.
PART_PAIRS, FAN, TASK_PAIRS = 1 << 15, 64, 1 << 20
#: Chunks that a worker remembers, and their greatest length; bytes of texts that are worked on at once (a longer text is alone).
KNOWN, LONG, SLICE = 160_000, 64, 1 << 20
#: Chunks that are encoded as one text, and fewest that are; bytes of ids that are aligned at once.
TOGETHER, FEW_CHUNKS, ALIGNED = 256, 8, 1 << 19

#: A pair is the id of A, then that of B in so many bits; together they have so many.
B_BITS, PAIR_BITS = 16, 34
PAIR = (1 << PAIR_BITS) - 1
#: Bits of a pair's mark, whose first bits are its part.
MARK_BITS = 20

CHUNK = re.compile(r"(?<=\S)(?= [\s\S])")

#: In groups with more links than this, distinct ids are counted first and links are products of counts.
FEW = 4096


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


@dataclass
class Aligned:
    """What texts give: numbers of groups and of links by text; the distinct pairs of text i, and how often each is linked there, from
    first[i] to first[i + 1]; where asked for, the groups in writing."""

    groups: np.ndarray
    links: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    first: np.ndarray
    written: pa.Array | None


class Encoder:
    """Chunks through both tokenizers."""

    def __init__(self, a_model: str, b_model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.b = SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = {i: bytes(alphabet[c] for c in piece) for piece, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = {i: self._piece(i) for i in range(self.b.get_piece_size())}
        #: Ids take 16 bits where that is enough, else 32.
        self.codes = ["H" if max(x) < 1 << 16 else "I" for x in (self.a_bytes, self.b_bytes)]
        self.known = Memo(self._encode, KNOWN)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and of B for each chunk; None where their bytes are not the chunk's."""
        found = {}
        for own in ([x for x in chunks if x.isascii() and not x[-1].isspace()], [x for x in chunks if not (x.isascii() or x[-1].isspace())]):
            found.update(zip(own, self._together(own), strict=True))
        others = [x for x in chunks if x not in found]
        found.update(zip(others, self._alone(others), strict=True))
        return [found[x] for x in chunks]

    def _alone(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        if not chunks:
            return []
        a, b = self.a.encode_batch_fast(chunks, add_special_tokens=False), self.b.encode([x[1:] for x in chunks], num_threads=1)
        out = []
        for chunk, i, j in zip(chunks, a, b, strict=True):
            i, own = i.ids, chunk.encode()
            same = b"".join(map(self.a_bytes.__getitem__, i)) == own and b"".join(map(self.b_bytes.__getitem__, j)) == own
            out.append((array(self.codes[0], i).tobytes(), array(self.codes[1], j).tobytes()) if same else None)
        return out

    def _together(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """As `_alone` for chunks that do not end in white space: they are encoded as texts of many, which cost less, and cut apart.

        Where bytes differ, halves are tried, down to few chunks.
        """
        if len(chunks) <= FEW_CHUNKS:
            return self._alone(chunks)
        texts = ["".join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)]
        whole = "".join(texts).encode()
        ends, sides = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in chunks]), []
        a = chain.from_iterable([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b = chain.from_iterable(self.b.encode([x[1:] for x in texts], num_threads=1))
        for ids, strings, code in ((list(a), self.a_bytes, self.codes[0]), (list(b), self.b_bytes, self.codes[1])):
            parts = [strings[i] for i in ids]
            stops = np.cumsum([len(x) for x in parts])
            cuts = np.searchsorted(stops, ends, side="right")
            if b"".join(parts) != whole or not np.array_equal(stops[cuts - 1], ends):
                half = len(chunks) // 2
                return self._together(chunks[:half]) + self._together(chunks[half:])
            data, cuts = array(code, ids).tobytes(), [0, *(cuts * array(code).itemsize).tolist()]
            sides.append([data[i:j] for i, j in pairwise(cuts)])
        return list(zip(*sides, strict=True))

    def __call__(self, texts: list[list[str]]) -> list[tuple[bytes, bytes] | None]:
        """Ids of texts in chunks; None for those that have no chunk or do not fit. Chunks that are not long are remembered."""
        chunks = set().union(*texts)
        long_ = [x for x in chunks if len(x) > LONG]
        found, rest, out = self.known.values(chunks.difference(long_)), dict(zip(long_, self._alone(long_), strict=True)), []
        for text in texts:
            own = [rest[x] if x in rest else found[x] for x in text] if rest else [found[x] for x in text]
            out.append(None if not own or None in own else (b"".join([x[0] for x in own]), b"".join([x[1] for x in own])))
        return out


@dataclass
class Sizes:
    """Bytes of each id of A and of B, and the types that ids are written in."""

    a: np.ndarray
    b: np.ndarray
    codes: list[str]

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, write: bool = False) -> Aligned:
        """Texts by their ids, one after the other, and their numbers of ids."""
        a_ends, b_ends = np.cumsum(self.a[a]), np.cumsum(self.b[b])
        # Both end where a text ends, so groups lie within texts.
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = (np.append(0, np.searchsorted(x, cuts, side="right")) for x in (a_ends, b_ends))
        text = np.repeat(np.arange(len(n_a)), n_a)[a_cuts[:-1]] if len(a) else np.zeros(0, np.int64)
        pairs, times = _links(a, b, a_cuts, b_cuts, text)
        places = np.arange(len(n_a) + 1)
        links = np.bincount(text, np.diff(a_cuts) * np.diff(b_cuts), minlength=len(n_a)).astype(np.int64)
        written = group_texts(a, b, a_cuts, b_cuts, np.searchsorted(text, places)) if write else None
        return Aligned(np.bincount(text, minlength=len(n_a)), links, pairs & PAIR, times, np.searchsorted(pairs >> PAIR_BITS, places), written)


def _links(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, pair), sorted, and how often each is linked."""
    sizes_a, sizes_b = np.diff(a_cuts), np.diff(b_cuts)
    many = sizes_a * sizes_b > FEW
    own = np.repeat(np.where(many, 0, sizes_b), sizes_a)  # links of each token of A
    token = np.repeat(np.arange(len(a)), own)
    place = np.arange(len(token)) - np.repeat(np.cumsum(own) - own, own)
    group = np.repeat(np.arange(len(text)), sizes_a)[token]
    parts = [(text[group] << PAIR_BITS) | (a[token] << B_BITS) | b[b_cuts[group] + place]]
    links = [np.ones(len(token), np.int64)]
    for k in np.flatnonzero(many):
        (i, m), (j, n) = np.unique(a[a_cuts[k] : a_cuts[k + 1]], return_counts=True), np.unique(b[b_cuts[k] : b_cuts[k + 1]], return_counts=True)
        parts.append(((text[k] << PAIR_BITS) | (i[:, None] << B_BITS) | j).ravel())
        links.append(np.outer(m, n).ravel())
    return sum_by_key(np.concatenate(parts), np.concatenate(links))


def group_texts(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, text_cuts: np.ndarray) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of each text."""
    sides = [pc.binary_join(list_array(cuts, pa.array(ids).cast(pa.string())), ",") for ids, cuts in ((a, a_cuts), (b, b_cuts))]
    return pc.binary_join(list_array(text_cuts, pc.binary_join_element_wise(*sides, "|")), ";")


def sum_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


def level_hash(pairs: np.ndarray, level: int) -> np.ndarray:
    return mix(pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def marks(pairs: np.ndarray) -> np.ndarray:
    return (level_hash(pairs, -1) >> np.uint64(64 - MARK_BITS)).astype(np.int32)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of levels, bits of all levels, and the keys in the order of their indices.

    On each level, keys that share no slot set its bit; the others go on to the next. A key's index is the number of bits before its own.
    """
    sizes, bits, placed, rest, begin = [], [], [], keys, 0
    while len(rest):
        size = 2 * len(rest) + 1
        slot = (level_hash(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        own = alone[slot]
        placed.append((slot[own] + begin, rest[own]))
        rest, begin = rest[~own], begin + size
    slots, keys = (np.concatenate(x) for x in zip(*placed, strict=True)) if placed else (np.zeros(0, np.int64), keys)
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), keys[np.argsort(slots)]


class PerfectHash:
    """The parts' hashes as one: index 0 to n - 1 of pairs by part."""

    def __init__(self, part_bits: int, parts: list[tuple[int, list[int], np.ndarray, np.ndarray]]) -> None:
        """parts: part, sizes, bits and keys in order."""
        self.part_bits = part_bits
        parts = sorted(parts, key=lambda x: x[0])
        depth = max([len(x[1]) for x in parts], default=0)
        self.size, self.begin = np.zeros((1 << part_bits, depth), np.int64), np.zeros((1 << part_bits, depth), np.int64)
        at = 0
        for part, sizes, _, _ in parts:
            self.size[part, : len(sizes)] = sizes
            self.begin[part, : len(sizes)] = at + np.cumsum([0, *sizes[:-1]])
            at += sum(sizes)
        self.bits = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        self.keys = np.concatenate([x[3] for x in parts]) if parts else np.zeros(0, np.int64)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """The index of each pair, -1 for those that are not there."""
        found = np.full(len(pairs), -1, np.int64)
        part, open_ = marks(pairs) >> (MARK_BITS - self.part_bits), np.arange(len(pairs))
        for level in range(self.size.shape[1]):
            size = self.size[part[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            slot = self.begin[part[open_], level] + (level_hash(pairs[open_], level) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[slot]
            found[open_[hit]] = self.rank[slot[hit]] - 1
            open_ = open_[~hit]
        there = found >= 0
        found[there] = np.where(self.keys[found[there]] == pairs[there], found[there], -1)
        return found


class PairTable:
    """Counts of the pairs that workers hold, and the best count of each id of A."""

    def __init__(self, hashed: PerfectHash, counts: np.ndarray, best: np.ndarray) -> None:
        self.hashed, self.counts, self.best = hashed, counts, best

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair (0 where it is not held), and whether that is the best one."""
        index = self.hashed.index(pairs)
        there = index >= 0
        count = np.where(there, self.counts[np.maximum(index, 0)], 0) if len(self.counts) else np.zeros(len(pairs), np.int64)
        return count, there & (count == self.best[pairs >> B_BITS])


@lru_cache(maxsize=1)
def encoder(a_model: str, b_model: bytes) -> Encoder:
    """A worker's tokenizers, with what it remembers."""
    return Encoder(a_model, b_model)


def token_sizes(a_model: str, b_model: bytes) -> Sizes:
    own = Encoder(a_model, b_model)
    if len(own.b_bytes) > 1 << B_BITS or max(own.a_bytes) >= 1 << (PAIR_BITS - B_BITS):
        raise ValueError("the vocabularies are too large for the bits of a pair")
    return Sizes(*(np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (own.a_bytes, own.b_bytes)), own.codes)


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """Chunks of some texts at a time, with the place of the first."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in slices(np.append(0, np.cumsum(sizes)), SLICE):
        yield low, [CHUNK.split(f" {x}") if x else [] for x in texts.slice(low, high - low).to_pylist()]


def encoded(documents: DataFrame, a_model: str, b_model: bytes) -> DataFrame:
    """row (a number for each), doc_id, and ids of A and of B as bytes; empty where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(a_model, b_model), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, texts in _text_slices(batch.column("text")):
                ids = own(texts)
                sides = [pa.array([x[side] if x else b"" for x in ids], pa.binary()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), batch.column("doc_id").slice(low, len(ids)), *sides], ["row", "doc_id", "a", "b"])
                row += len(ids)

    return text_of(documents).mapInArrow(run, "row long, doc_id long, a binary, b binary")


def _id_slices(batch: pa.RecordBatch, codes: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time, with their ids and numbers of ids."""
    sizes = pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False)
    for low, high in slices(np.append(0, np.cumsum(sizes.astype(np.int64))), ALIGNED):
        own, out = batch.slice(low, high - low), []
        for name, code in zip("ab", codes, strict=True):
            data, offsets = text_bytes(own.column(name))
            out += [data.view(code).astype(np.int64), np.diff(offsets) // np.dtype(code).itemsize]
        yield own, *out


def _count_pairs(ids: DataFrame, sizes: Sizes) -> DataFrame:
    """How many documents hold a pair linked, by task: salt, mark, pair, docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        encoder.cache_clear()  # what this worker remembers of texts is not needed now
        waiting, n_waiting, held = [], 0, nothing
        salt = TaskContext.get().partitionId() // FAN

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([held[0], *waiting])
            return sum_by_key(new, np.concatenate([held[1], np.ones(len(new) - len(held[0]), np.int64)]))

        def rows(pairs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), salt, np.int32)), pa.array(marks(pairs)), pa.array(pairs), pa.array(docs)], ["salt", "mark", "pair", "docs"])

        for batch in batches:
            for _, *own in _id_slices(batch, sizes.codes):
                waiting.append(sizes.align(*own).pairs)
                n_waiting += len(waiting[-1])
                if n_waiting > TASK_PAIRS:
                    held, waiting, n_waiting = merged(), [], 0
                    if len(held[0]) > TASK_PAIRS:
                        yield rows(*held)
                        held = nothing
        held = merged()
        if len(held[0]):
            yield rows(*held)

    return ids.select("a", "b").mapInArrow(run, "salt int, mark int, pair long, docs long")


_PART = "part int, sizes array<int>, bits binary, keys array<long>"


def _part_row(part: int, keys: np.ndarray) -> dict[str, pa.Array]:
    sizes, bits, keys = perfect_hash(keys)
    return {"part": pa.array([part], pa.int32()), "sizes": list_array([0, len(sizes)], pa.array(sizes, pa.int32())), "bits": pa.array([np.packbits(bits).tobytes()]), "keys": list_array([0, len(keys)], pa.array(keys))}


def _part(row: dict) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """A part of the hash from its row."""
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
    return row["part"], row["sizes"], bits, np.array(row["keys"], np.int64)


def hashed_parts(keys: DataFrame, part_bits: int) -> DataFrame:
    """The perfect hash of distinct pairs (mark, pair), a row a part."""

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        return pa.table(_part_row(part, np.sort(table.column("pair").to_numpy())))

    return keys.select(_part_of(part_bits), "pair").groupBy("part").applyInArrow(build, _PART)


def _part_of(part_bits: int) -> Column:
    return F.shiftright("mark", MARK_BITS - part_bits).alias("part")


def dense_counts(partial: DataFrame, parts: DataFrame, part_bits: int, salts: int) -> DataFrame:
    """part and counts (longs by index, as bytes): a vector for each part and some tasks, then sums of FAN vectors until one is left."""

    def count(rows: pa.Table, part: pa.Table) -> pa.Table:
        number, salt = part.column("part")[0].as_py(), part.column("salt")[0].as_py()
        hashed = PerfectHash(part_bits, [_part(part.drop_columns(["salt"]).to_pylist()[0])])
        counts = np.zeros(len(hashed.keys), np.int64)
        if rows.num_rows:
            index = hashed.index(rows.column("pair").to_numpy())
            if (index < 0).any():
                raise ValueError("a pair is missing in the hash that was built of all pairs")
            np.add.at(counts, index, rows.column("docs").to_numpy())
        return pa.table({"part": pa.array([number], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([counts.tobytes()])})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
        return pa.table({"part": rows.column("part")[:1], "salt": rows.column("salt")[:1], "counts": pa.array([total.tobytes()])})

    kind = "part int, salt int, counts binary"
    spread = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = partial.select(_part_of(part_bits), "salt", "pair", "docs")
    vectors = own.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInArrow(count, kind)
    while salts > 1:
        vectors, salts = vectors.withColumn("salt", F.expr(f"salt div {FAN}").cast("int")).groupBy("part", "salt").applyInArrow(add, kind), -(-salts // FAN)
    return vectors.select("part", "counts")


def _part_bits(pairs: int) -> int:
    return min(max(-(-pairs // PART_PAIRS) - 1, 0).bit_length(), MARK_BITS)


def _pair_counts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """pair and count, a row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, own in zip(batch.column("keys"), batch.column("counts"), strict=True):
                keys = keys.values
                yield pa.RecordBatch.from_arrays([pa.array(marks(keys.to_numpy())), keys, pa.array(np.frombuffer(own.as_py(), np.int64))], ["mark", "pair", "count"])

    return parts.join(counts, "part").select("keys", "counts").mapInArrow(rows, "mark int, pair long, count long")


@dataclass
class PairCounts:
    """The table that workers hold, and the pairs that it does not (None: it holds all)."""

    table: PairTable
    rest: DataFrame | None


def corpus_counts(scratch: Scratch, ids: DataFrame, sizes: Sizes, head: int = HEAD_PAIRS) -> PairCounts:
    """How many documents hold each pair, over all documents; of more than `head` pairs, workers hold those with the highest counts."""
    partial = scratch.table(_count_pairs(ids, sizes), "alignment-partial")
    keys = scratch.table(partial.select("mark", "pair").distinct(), "alignment-pairs")
    n, salts = keys.count(), (partial.agg(F.max("salt")).first()[0] or 0) + 1
    bits = _part_bits(n)
    parts = scratch.table(hashed_parts(keys, bits), "alignment-hash")
    counts = scratch.table(dense_counts(partial, parts, bits, salts), "alignment-counts")
    listed = _pair_counts(parts, counts)
    rest = None
    if n > head:
        listed = scratch.table(listed, "alignment-listed")
        powers = {r["power"]: r["n"] for r in listed.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
        least = next(p for p in range(65) if sum(k for q, k in powers.items() if q >= p) <= head)
        frequent = F.floor(F.log2("count")) >= least
        rest, kept = listed.where(~frequent), listed.where(frequent)
        bits = _part_bits(head)
        parts = hashed_parts(kept, bits)
        listed = kept
        counts = dense_counts(kept.select(F.lit(0).alias("salt"), "mark", "pair", F.col("count").alias("docs")), parts, bits, 1)
    # At most `head` pairs, some 17 bytes each, and one number for each id of A.
    held = parts.join(counts, "part").toArrow().to_pylist()
    hashed = PerfectHash(bits, [_part(x) for x in held])
    vector = [np.frombuffer(x["counts"], np.int64) for x in sorted(held, key=lambda x: x["part"])]
    every = listed if rest is None else listed.unionByName(rest)
    best = every.groupBy(F.shiftright("pair", B_BITS).cast("int").alias("a")).agg(F.max("count").alias("best")).toArrow()
    highest = np.zeros(max(best.column("a").to_pylist(), default=-1) + 1, np.int64)
    highest[best.column("a").to_numpy()] = best.column("best").to_numpy()
    return PairCounts(PairTable(hashed, np.concatenate(vector) if vector else np.zeros(0, np.int64), highest), rest)


_KIND = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, "
    "groups_sha256 string, rest array<struct<pair:bigint,links:bigint,best:bigint>>"
)


def _second_pass(ids: DataFrame, sizes: Sizes, table: PairTable, groups_too: bool) -> DataFrame:
    held = ids.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        encoder.cache_clear()
        for batch in batches:
            for rows, a, n_a, b, n_b in _id_slices(batch, sizes.codes):
                aligned = sizes.align(a, n_a, b, n_b, write=True)
                count, best = table.look_up(aligned.pairs)
                sums = [np.diff(np.append(0, np.cumsum(x * aligned.times))[aligned.first]) for x in (best, count)]
                hashes = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in aligned.written.to_pylist()]
                absent = np.flatnonzero(count == 0)
                rest = [aligned.pairs[absent], aligned.times[absent], table.best[aligned.pairs[absent] >> B_BITS]]
                rest = pa.StructArray.from_arrays([pa.array(x) for x in rest], ["pair", "links", "best"])
                columns = [rows.column("row"), rows.column("doc_id"), *map(pa.array, (n_a, n_b, aligned.groups, aligned.links, *sums))]
                columns += [aligned.written if groups_too else pa.nulls(len(n_a), pa.string()), pa.array(hashes, pa.string()), list_array(np.searchsorted(absent, aligned.first), rest)]
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _KIND.split(", ")])

    return ids.mapInArrow(run, _KIND)


def align(documents: DataFrame, a_path: str, b_path: str, groups: bool = False, head: int = HEAD_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (the text, where asked for), groups_sha256.

    Tokenizer A is a byte-level BPE (JSON), B a piece model that puts a space before a text; A reads that space too. Null and empty
    texts, and ones whose bytes either does not give back, have no tokens: zeros, and '' for the groups and their hash.
    Repeated rows and ids, and null ids, are rows like any other, and each counts; no rows give no rows. Strings of special
    tokens are ordinary text.
    """
    with open(a_path, encoding="utf-8") as f:
        a_model = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    scratch, kept = Scratch(documents.sparkSession), Scratch(documents.sparkSession)
    sizes = token_sizes(a_model, b_model)
    ids = kept.table(encoded(documents, a_model, b_model), "alignment-ids")
    counted = corpus_counts(scratch, ids, sizes, head)
    found = _second_pass(ids, sizes, counted.table, groups)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    if counted.rest is None:
        scratch.drop()
        return found.select(*columns)
    # Pairs that workers do not hold are rare ones, so no key of this join is hot.
    found = scratch.table(found, "alignment-found")
    asked = found.select("row", F.explode("rest").alias("own")).select("row", "own.*")
    added = asked.join(counted.rest.select("pair", "count"), "pair").groupBy("row").agg(
        F.sum(F.col("links") * F.col("count")).alias("more_sum"), F.sum(F.when(F.col("count") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best")
    )
    whole = found.join(added, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
    })
    result = scratch.result(whole.select(*columns), "alignment")
    kept.drop()
    return result
