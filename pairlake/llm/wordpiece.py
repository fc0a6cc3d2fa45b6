"""Token counts by linear longest-match: greedy word-piece lengths without building the pieces.

The vocabulary is a public tokenizer's: an entry that begins with the marker of a word's start is an
initial piece, the others continue a word; all single bytes are entries, so no word is unknown. A word
is its start marker and its UTF-8 bytes. The automaton is a trie over bytes. Where a byte doesn't go
on from a node, its failure link leads to the node for what is left after the greedy pieces of the
path so far, and its popped count says how many pieces those are. So each byte is read once, and a
word's count needs no back-tracking, whatever its length.

Words are parted by the six ASCII white space characters. Null, empty or blank text has 0 words and 0
tokens. Repeated rows are counted each; a null doc_id keeps its row. Other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

START = b" "
#: Words whose count a worker keeps.
CACHE = 150_000


def vocabulary(name: str) -> list[bytes]:
    """The entries of a byte-level vocabulary file as bytes."""
    import public_tokenizers

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}  # the public byte-to-character rule
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    return [bytes(byte[c] for c in e) for e in entries if all(c in byte for c in e)]


class Automaton:
    """Longest-match pieces of words: next node by byte, failure links and counts of popped pieces."""

    def __init__(self, pieces: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for p in pieces:
            at = 0
            for b in p:
                if b not in self.next[at]:
                    self.next[at][b] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                at = self.next[at][b]
            ends[at] = at > 0
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for b, v in self.next[u].items():
                todo.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                at, n = self.fail[u], self.popped[u]
                while at >= 0 and b not in self.next[at]:
                    at, n = self.fail[at], n + self.popped[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.next[at][b], n
        self.counts: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of START + word; a byte that no entry starts with counts as one piece."""
        at = n = 0
        goes, fail, popped = self.next, self.fail, self.popped
        for b in START + word:
            while at >= 0 and b not in goes[at]:
                n += popped[at] if at else 0
                if not at:
                    n, at = n + 1, -2  # an unknown byte
                    break
                at = fail[at]
            if at == -2:
                at = 0
                continue
            if at < 0:
                raise ValueError("the vocabulary lacks single bytes")
            at = goes[at][b]
        while at > 0:
            n, at = n + popped[at], fail[at]
        if at < 0:
            raise ValueError("the vocabulary lacks single bytes")
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.of = automaton.count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.of(word)
        return n


@lru_cache(2)
def _counts(name: str) -> _Counts:
    return _Counts(Automaton(vocabulary(name)))


def n_tokens(text: Column | str, tokenizer: str = "byte_bpe_50k") -> Column:
    """The tokens of a text as a column."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        get = _counts(tokenizer).__getitem__
        return pa.array([sum(map(get, (t.as_py() or b"").split())) for t in texts], pa.int64())

    text = F.col(text) if isinstance(text, str) else text
    return count(text.cast("binary"))


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, n_words, n_tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _counts(tokenizer).__getitem__
        for batch in small(batches):
            words = [(t.as_py() or b"").split() for t in batch[1]]
            n, tokens = pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0], n, tokens], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_tokens long")
