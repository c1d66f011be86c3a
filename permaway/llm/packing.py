"""Packing of documents into token windows by the sum-of-squares rule.

Every task packs the rows of its partition as they come and moves none. What a document has beyond whole windows goes to the
fill level at which the sum of the squared counts of open windows, held in an array by level, ends smallest. Windows are
put out when they are full. Since documents may be cut, open windows beyond a bound are closed by filling the fullest from
the emptiest, as are those left at the end; the last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from permaway.llm.memo import Memo
from permaway.llm.store import text_of

#: Windows that a task holds open.
OPEN_WINDOWS = 512
#: Words whose ids a worker remembers (some 400 bytes each); bytes of pieces in one batch of rows; texts that are tokenised at once, and new words in one of them.
KNOWN, BATCH_BYTES, TEXTS, WORDS = 800_000, 8 << 20, 512, 256

Piece = tuple[int, int, int]  # document, its ids before the piece, ids in the piece


class Packer:
    """Windows by the sum-of-squares rule; full ones leave through `take`."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open, self.full = 0, []

    def level_for(self, size: int) -> int:
        """The fill level that the next `size` ids go to; 0 is a new window. Of equal levels the fullest."""
        room = np.flatnonzero(self.count[1 : self.capacity - size + 1]) + 1
        if not len(room):
            return 0
        end = room + size
        change = 1 - 2 * self.count[room] + np.where(end < self.capacity, 2 * self.count[end] + 1, 0)
        best = len(room) - 1 - int(np.argmin(change[::-1]))
        return int(room[best]) if change[best] <= 2 * self.count[size] + 1 else 0

    def put(self, document: int, size: int) -> None:
        start = 0
        while size - start >= self.capacity:
            self.full.append([(document, start, self.capacity)])
            start += self.capacity
        if start < size:
            level = self.level_for(size - start)
            window = self._leave(level) if level else []
            self._enter([*window, (document, start, size - start)], level + size - start)
            if self.n_open > OPEN_WINDOWS:
                self.settle(OPEN_WINDOWS // 2)

    def _leave(self, level: int) -> list[Piece]:
        window = self.open[level].pop()
        if not self.open[level]:
            del self.open[level]
        self.count[level] -= 1
        self.n_open -= 1
        return window

    def _enter(self, window: list[Piece], level: int) -> None:
        if level == self.capacity:
            self.full.append(window)
        elif level:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1
            self.n_open += 1

    def settle(self, most: int) -> None:
        """Fill the fullest windows with what the emptiest hold, cut as needed, until at most so many are open."""
        while self.n_open > max(most, 1):
            low, high = min(self.open), max(self.open)
            giver, taker = self._leave(low), self._leave(high)
            while giver and high < self.capacity:
                document, start, size = giver.pop()
                moved = min(size, self.capacity - high)
                if moved < size:
                    giver.append((document, start, size - moved))
                taker.append((document, start + size - moved, moved))
                high, low = high + moved, low - moved
            self._enter(taker, high)
            self._enter(giver, low)

    def finish(self) -> None:
        """Close all; the last window is cut into ones of a power of two."""
        self.settle(1)
        for level in list(self.open):
            pieces = self._leave(level)[::-1]
            while level:
                need, window = 1 << (level.bit_length() - 1), []
                level -= need
                while need:
                    document, start, size = pieces.pop()
                    used = min(size, need)
                    if used < size:
                        pieces.append((document, start + used, size - used))
                    window.append((document, start, used))
                    need -= used
                self.full.append(window)

    def take(self) -> list[list[Piece]]:
        full, self.full = self.full, []
        return full


class WordIds:
    """Ids of texts by a tokenizer that drops white space. New words are encoded many at once, with a special token between them."""

    def __init__(self, model: str, remember: int = KNOWN) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        added = self.tokenizer.get_added_tokens_decoder()
        plain = {i: x.content for i, x in added.items() if x.special and not x.normalized and x.content.isascii() and not x.content.isspace()}
        self.border, self.mark = next(iter(plain.items()), (None, None))
        #: A tokenizer that lowers letters gives words in capitals the ids of small ones; special tokens are found before that.
        self.special = [x.content.encode() for x in added.values()]
        self.lowers = '"Lowercase"' in json.dumps(json.loads(model).get("normalizer"))
        self.known = Memo(self._encode, remember)

    def _words(self, text: str | None) -> list[bytes]:
        data = (text or "").encode()
        if self.lowers:
            low = data.lower()
            data = data if any(x in low for x in self.special) else low
        return data.split()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        mark = self.mark.encode() if self.mark else b""
        found = {}
        together = [x for x in words if mark not in x] if mark else []
        for low in range(0, len(together), WORDS * TEXTS):
            some = together[low : low + WORDS * TEXTS]
            found.update(zip(some, self._together(some), strict=True))
        others = [x for x in words if x not in found]
        alone = self.tokenizer.encode_batch_fast([x.decode() for x in others], add_special_tokens=False)
        found.update(zip(others, (array("I", x.ids).tobytes() for x in alone), strict=True))
        return [found[x] for x in words]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that do not hold the mark; each text of many words ends with the mark too."""
        border = f" {self.mark} ".encode()
        texts = [border.join([*words[i : i + WORDS], b""]).decode() for i in range(0, len(words), WORDS)]
        ids = np.array(list(chain.from_iterable([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])), np.uint32)
        ends = np.flatnonzero(ids == self.border)
        data, cuts = ids.tobytes(), [-4, *(4 * ends).tolist()]
        return [data[i + 4 : j] for i, j in pairwise(cuts)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [self._words(x) for x in texts]
        ids = self.known.values(set().union(*words))
        # itemgetter gives a tuple of two values at least, so the last key comes twice.
        return [b"".join(itemgetter(*x, x[-1])(ids)[:-1]) if x else b"" for x in words]


@lru_cache(maxsize=1)
def word_ids(model: str, remember: int) -> WordIds:
    return WordIds(model, remember)


def pack(documents: DataFrame, model_path: str, end_id: int, capacity: int = 4096, remember: int = KNOWN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    A document is the ids of its text and end_id; a null or empty text is end_id alone. Pieces of a sequence follow each
    other from offset 0. Sequences hold `capacity` ids, but for at most 12 a task that hold a power of two. The tokenizer
    must drop white space and tokenise the words between by themselves; strings of special tokens in a text give their ids, as
    the tokenizer's file has it.
    Repeated rows and null ids are rows like any other; no rows give no rows.
    """
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    end = int(end_id).to_bytes(4, "little")
    kind = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(model, remember), Packer(capacity)
        held: dict[int, list] = {}  # of documents with pieces in open windows: doc_id, ids, ids not put out
        sequence, number = TaskContext.get().partitionId() << 40, 0

        def rows() -> Iterator[tuple]:
            nonlocal sequence
            for window in packer.take():
                offset = 0
                for document, start, length in window:
                    own = held[document]
                    yield own[0], start, length, own[1][4 * start : 4 * (start + length)], len(own[1]) // 4, sequence, offset
                    offset += length
                    own[2] -= length
                    if not own[2]:
                        del held[document]
                sequence += 1

        def table(out: list[tuple]) -> pa.RecordBatch:
            doc_id, start, length, ids, tokens, sequences, offset = zip(*out, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (doc_id, start, length, tokens, sequences, offset)]
            return pa.RecordBatch.from_arrays([*longs[:3], pa.array(ids, pa.binary()), *longs[3:]], [x.split(" ")[0] for x in kind.split(", ")])

        out, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of(part.column("text").to_pylist()), strict=True):
                    ids += end
                    held[number] = [doc_id, ids, len(ids) // 4]
                    packer.put(number, len(ids) // 4)
                    number += 1
                for row in rows():
                    out.append(row)
                    size += len(row[3])
                if size > BATCH_BYTES:
                    yield table(out)
                    out, size = [], 0
        packer.finish()
        out.extend(rows())
        if out:
            yield table(out)

    return text_of(documents).mapInArrow(work, kind)
