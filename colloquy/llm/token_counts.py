"""Token counts of whole texts by greedy longest match over a word-piece vocabulary, in one pass and without pieces.

The automaton is the vocabulary's trie. Every node has a failure link to the node from which matching goes on once
no longer piece is possible, and the number of pieces that following the link settles. Reading a byte therefore
costs one step down plus links that each settle a piece, so a word of n bytes takes O(n), whatever its pieces.

Words are runs of ``[^\\x20\\x09-\\x0D]``; a word that the vocabulary cannot spell counts as one unknown token. A null
text has no words. Each text is counted in its own row: one scan, no shuffle.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CACHED_WORDS = 300_000


class PieceCounter:
    """Longest-match automaton: ``first`` pieces may start a word, ``rest`` pieces may go on with it."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.step: list[dict[int, int]] = [{}, {}]  # node 0: start of a word, node 1: inside a word
        ends = [set(), set()]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.step[node].setdefault(c, len(self.step))
                    if node == len(self.step):
                        self.step.append({})
                if piece:
                    ends[root].add(node)
        self.link: list[int] = [-1] * len(self.step)  # -1: no way on
        self.pops: list[int] = [0] * len(self.step)
        whole = ends[0] | ends[1]
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.step[parent].items():
                if node in whole:
                    self.link[node], self.pops[node] = 1, 1
                else:
                    z, settled = self.link[parent], self.pops[parent]
                    while z >= 0 and c not in self.step[z]:
                        settled += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[node], self.pops[node] = self.step[z][c], settled
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 if it cannot be spelt, 0 if it is empty."""
        step, link, pops = self.step, self.link, self.pops
        node = n = 0
        for c in word:
            while (after := step[node].get(c)) is None:
                if link[node] < 0:
                    return 1
                n += pops[node]
                node = link[node]
            node = after
        while node > 1:
            if link[node] < 0:
                return 1
            n += pops[node]
            node = link[node]
        return n


_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
# A byte-level vocabulary file shows printable bytes as themselves and the others from code point 256 on.
_SHOWN = {chr(b): b for b in _PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN_BYTES)))}


def byte_values(piece: str) -> bytes:
    return bytes(_SHOWN[c] for c in piece)


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    return [byte_values(piece) for piece in model["model"]["vocab"] if piece not in special]


@lru_cache(maxsize=4)
def _counter(pieces: tuple[bytes, ...]) -> PieceCounter:
    return PieceCounter(pieces, pieces)


class _Counts(dict):
    """Counts by word; forgets all once it holds many words, so its memory is bounded."""

    def __init__(self, counter: PieceCounter, prefix: bytes):
        self.counter, self.prefix = counter, prefix

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self.counter.count(self.prefix + word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text", prefix: bytes = b" ") -> DataFrame:
    """doc_id, n_words and n_tokens of every row. Each word is counted after ``prefix``, its mark in the vocabulary."""
    vocabulary = tuple(pieces)
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Counts(_counter(vocabulary), prefix)
        for rows in batches:
            words = [_WORD.findall((t or "").encode()) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(known.__getitem__, w)) for w in words]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(count, f"doc_id {id_type}, n_words long, n_tokens long")


def report(docs: DataFrame, path: str) -> DataFrame:
    return token_counts(docs, byte_pieces(path))
