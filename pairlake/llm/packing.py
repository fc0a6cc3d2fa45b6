"""Best-fit packing by minimum bin slack.

Texts become token ids, only documents over the sequence length are cut, and the pieces fill
sequences. What is packed is the histogram of piece lengths, at most ``seq_len`` numbers whatever
the corpus holds: per bin, a subset-sum dynamic program over bitsets (big integers) finds the fullest
feasible combination of the lengths that are left, which is then taken out as many times as the
counts allow. Spark numbers the pieces of one length in salted groups, so a length that a third of
the corpus has doesn't meet in one task, and each piece looks its place up by its number.

Null text is an empty document (one piece with the end token alone). Repeated rows are packed once
each. A null doc_id stays null. Other columns are not read. An empty table gives no pieces. A very long
text is encoded in parts that end where the pattern always parts text; only its ids are held whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

SEQ_LEN = 1024
EOS = 2
#: Pieces of one length that are numbered by one task, about.
PER_SALT = 50_000
#: Chunks of text whose ids a worker keeps, bytes of them, and characters that are encoded at once.
CACHE, CACHE_BYTES, PART = 50_000, 4_000_000, 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids(dict):
    """The ids of a chunk of text as little-endian uint32 bytes."""

    def __init__(self, ranks):
        self.encode, self.held = ranks.encode_ordinary, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        self.held += len(chunk) + len(ids)
        if len(self) >= CACHE or self.held > CACHE_BYTES:
            self.clear()
            self.held = len(chunk) + len(ids)
        self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts as ``tokenizers`` gives them for a byte-level BPE file.

    The rank file of the same vocabulary gives the same ids and is faster; it takes chunks that begin
    with a single space after a visible character, where the pattern always parts text, so chunks can
    be remembered. Parts that hold a special token's string go through ``tokenizers`` itself, which is
    loaded when the first of them is met.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        self.path, self.whole = public_tokenizers.path(f"{name}.json"), None
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.spaces = re.compile(r"\s ")
        self.safe = re.compile(r"(?<=\S) ")
        self.chunks = _Ids(self.ranks)

    def __call__(self, text: str) -> bytes:
        if len(text) <= PART:
            return self.part(text)
        out, at = [], 0
        while at < len(text):
            cut = self.safe.search(text, at + PART)
            end = cut.start() if cut else len(text)
            out.append(self.part(text[at:end]))
            at = end
        return b"".join(out)

    def part(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.spaces.search(text):
            return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        get = self.chunks.__getitem__
        return (get(first) if first else b"") + b"".join([get(" " + x) for x in rest])


@lru_cache(1)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", seq_len: int = SEQ_LEN, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with_ids the ids as bytes."""
    end = np.array([eos], "<u4").tobytes()
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in small(batches):
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, text in zip(batch[0].to_pylist(), batch[1]):
                ids = encode(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                step = n % seq_len or seq_len
                for k in range(-(-n // seq_len)):
                    part = ids[4 * at : 4 * (at + step)]
                    for column, value in zip(out, (doc, k, at, step, zlib.crc32(part), part)):
                        column.append(value)
                    at, step = at + step, seq_len
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths that fills most of ``room``, the longer ones first.

    reach[i] has bit t set if the i smallest lengths can sum to t; a copy of a length is an item of its
    own, in powers of two.
    """
    items, reach, now = [], [], 1
    full = (1 << (room + 1)) - 1
    for length in sorted(counts):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            reach.append(now)
            items.append((length, k))
            now |= (now << (length * k)) & full
            left, k = left - k, 2 * k
    at = now.bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(items) - 1, -1, -1):
        length, k = items[i]
        if at >= length * k and reach[i] >> (at - length * k) & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= length * k
    return chosen


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> copies, times the bin is made); each holds the longest length that is left."""
    left, bins = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({k: v for k, v in rest.items() if v and k <= seq_len - longest}, seq_len - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        bins.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def slots(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, copies in a bin, first bin, offset in the bin), by first number."""
    rows: dict[int, list] = {}
    numbered: dict[int, int] = {}
    first = 0
    for chosen, times in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.setdefault(length, []).append((numbered.get(length, 0), n, first, offset))
            numbered[length] = numbered.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", seq_len: int = SEQ_LEN, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with its sequence_id and its offset there."""
    cut = written(pieces(docs, tokenizer, seq_len, eos, with_ids), "pieces")
    rows = cut.count()
    salts = max(1, -(-rows // PER_SALT))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    by_length = Window.partitionBy("length").orderBy("salt")
    before = sizes.withColumn("before", F.sum("count").over(by_length) - F.col("count")).drop("count")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # seq_len rows at most
    places = slots(plan(counts, seq_len))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 5000):
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                at = places[int(n)]
                row = at[np.searchsorted(at[:, 0], number[own], side="right") - 1]
                k = number[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * n
            kept = batch.select([f.name for f in batch.schema if f.name != "number"])
            kept = kept.append_column("sequence_id", pa.array(sequence))
            yield kept.append_column("offset", pa.array(offset))

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    numbered = salted.withColumn("k", F.row_number().over(order)).join(before, ["length", "salt"])
    numbered = numbered.select(*cut.columns, (F.col("before") + F.col("k") - 1).cast("long").alias("number"))
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)
