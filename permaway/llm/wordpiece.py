"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over UTF-8 bytes. A node's failure link leads to the node of what is left once the longest matches
at the front of its string are popped, and the number of tokens popped is kept with it. A word is read once, byte by byte:
where the trie has no edge, the failure link is taken and its count added. So the greedy pieces are counted and not built.
Many words are read side by side, one byte of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from permaway.llm.memo import Memo
from permaway.llm.store import map_batches, text_of

#: Words that a worker remembers, and texts that are counted at once.
KNOWN, TEXTS = 300_000, 512
#: Added for a word that the vocabulary cannot make; it counts as one token.
UNKNOWN = 1 << 40


class Automaton:
    """Trie, failure links and popped-token counts of a vocabulary of byte strings."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        edges: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if (following := edges[node].get(byte)) is None:
                    following = edges[node][byte] = len(edges)
                    edges.append({})
                    whole.append(False)
                node = following
            whole[node] = bool(piece)
        self.failure, self.popped = np.full(len(edges), -1, np.int64), np.zeros(len(edges), np.int64)
        failure, popped = [-1] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in edges[node].items():
                    below.append(child)
                    if whole[child]:
                        failure[child], popped[child] = 0, 1
                        continue
                    rest, count = failure[node], popped[node]
                    while rest >= 0 and byte not in edges[rest]:
                        rest, count = failure[rest], count + popped[rest]
                    if rest >= 0:
                        failure[child], popped[child] = edges[rest][byte], count
            level = below
        self.failure, self.popped = np.array(failure), np.array(popped)
        keys = np.array([node << 8 | byte for node, out in enumerate(edges) for byte in out], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.targets = np.array([x for out in edges for x in out.values()], np.int64)[order]

    def _follow(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(nodes), -1)
        keys = nodes << 8 | bytes_
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.targets[at], -1)

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each word by longest match; UNKNOWN + 1 for words that cannot be made."""
        lengths = np.array([len(x) for x in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in words])])[:-1].astype(np.int64)[order]
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while (n := int(np.searchsorted(-lengths, -step, side="left"))) > 0:
            self._pop(node, count, np.arange(n), data[begin[:n] + step])
            step += 1
        self._pop(node, count, np.arange(len(words)), None)
        out = np.empty(len(words), np.int64)
        out[order] = np.where(node < 0, UNKNOWN + 1, count)
        return out.tolist()

    def _pop(self, node: np.ndarray, count: np.ndarray, words: np.ndarray, bytes_: np.ndarray | None) -> None:
        """Read a byte of each word, or its end: follow failure links until an edge, or the root, is met. -1: no way on."""
        words_left = words[node[words] >= 0] if bytes_ is None else words
        if bytes_ is not None:
            alive = node[words] >= 0
            words_left, bytes_ = words[alive], bytes_[alive]
        while len(words_left):
            if bytes_ is None:
                stuck = node[words_left] > 0
            else:
                following = self._follow(node[words_left], bytes_)
                stuck = following < 0
                node[words_left[~stuck]] = following[~stuck]
                bytes_ = bytes_[stuck]
            words_left = words_left[stuck]
            count[words_left] += self.popped[node[words_left]]
            node[words_left] = self.failure[node[words_left]]
            lost = node[words_left] < 0
            words_left = words_left[~lost]
            bytes_ = None if bytes_ is None else bytes_[~lost]


def sentence_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, its word marker included; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


@lru_cache(maxsize=2)
def _memo(pieces: tuple[str, ...], marker: str) -> Memo:
    automaton, front = Automaton(x.encode() for x in pieces), marker.encode()
    return Memo(lambda words: automaton.counts([front + x for x in words]), KNOWN)


def count_tokens(documents: DataFrame, pieces: list[str], marker: str = "") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row.

    Each word, with the marker before it, is cut greedily into the longest pieces; a word that cannot be cut whole is one
    unknown token. A null or empty text has none. Repeated rows and null ids are rows like any other; no rows give no rows.
    """
    vocabulary = tuple(pieces)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        memo = _memo(vocabulary, marker)
        for low in range(0, batch.num_rows, TEXTS):
            part = batch.slice(low, TEXTS)
            words = [(x or "").encode().split() for x in part.column("text").to_pylist()]
            known = memo.values(set().union(*words))
            totals = [sum(map(known.__getitem__, x)) for x in words]
            yield {
                "doc_id": part.column("doc_id"), "n_words": pa.array([len(x) for x in words], pa.int64()),
                "n_tokens": pa.array([x % UNKNOWN for x in totals], pa.int64()), "n_unknown": pa.array([x // UNKNOWN for x in totals], pa.int64()),
            }

    return map_batches(text_of(documents), work, "doc_id long, n_words long, n_tokens long, n_unknown long")
