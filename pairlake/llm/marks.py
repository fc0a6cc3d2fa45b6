"""Filters of bounded size for what a second scan has to look at.

Both are bitmaps: a bit that is set for something else lets more through, which costs work and never
changes a result. They follow the input up to MOST_HASH_BITS and MOST_ID_BITS (32 and 8 MB), so they may
go to every task; far beyond that they fill up and prune less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmaps as powers of two, of hashes and of ids: the least and the most.
HASH_BITS, MOST_HASH_BITS, ID_BITS, MOST_ID_BITS = 22, 28, 18, 26
#: Hashes that a task holds before it deals them out, and hashes that meet in a bucket, about.
HELD, PER_BUCKET = 1_000_000, 1_000_000


class Repeats:
    """Which 64-bit hashes come from two arrays or more, as a bitmap by their first bits.

    Only the 32 bits after a hash's bucket travel; those meet by bucket. expected: about how many hashes there are.
    """

    def __init__(self, expected: int):
        self.bits = int(np.clip(np.ceil(np.log2(max(1, expected) / PER_BUCKET)), 4, 14))
        size = int(np.clip(np.ceil(np.log2(max(1, expected))), HASH_BITS, MOST_HASH_BITS))
        self.inner = size - self.bits

    def deal(self, held: list[np.ndarray]) -> list[pa.Array]:
        """(bucket, hashes met once, hashes met again) of arrays without repeats."""
        found, n = np.unique(np.concatenate(held) >> np.uint64(32 - self.bits), return_counts=True)
        cuts = np.searchsorted(found, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(32))
        once = [x.astype(np.uint32).tobytes() for x in np.split(found, cuts)]
        more = [x[k > 1].astype(np.uint32).tobytes() for x, k in zip(np.split(found, cuts), np.split(n, cuts))]
        return [pa.array(range(1 << self.bits), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())]

    def meet(self, once: pa.ChunkedArray, more: pa.ChunkedArray) -> bytes:
        """A bucket's part of the bitmap."""
        mark = np.zeros(1 << self.inner, bool)
        found = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in once]))
        found = np.concatenate([found[1:][found[1:] == found[:-1]], *(np.frombuffer(x.as_buffer(), np.uint32) for x in more)])
        mark[found >> np.uint32(32 - self.inner)] = True
        return np.packbits(mark).tobytes()

    def bitmap(self, parts: dict[int, bytes]) -> bytes:
        return b"".join(parts.get(i, bytes((1 << self.inner) // 8)) for i in range(1 << self.bits))


def repeated(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int) -> bytes:
    """The bitmap of hashes that come from two of the arrays or more; hashes makes arrays of uint64, each without repeats."""
    repeats = Repeats(expected)
    names = ["bucket", "once", "more"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in hashes(batches):
            held.append(x)
            n += len(x)
            if n >= HELD:
                yield pa.RecordBatch.from_arrays(repeats.deal(held), names=names)
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(repeats.deal(held), names=names)

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"][:1], "mark": pa.array([repeats.meet(table["once"], table["more"])], pa.binary())})

    dealt = df.mapInArrow(scan, "bucket int, once binary, more binary")
    return repeats.bitmap({r["bucket"]: bytes(r["mark"]) for r in dealt.groupBy("bucket").applyInArrow(meet, "bucket int, mark binary").collect()})  # 2^MOST_HASH_BITS bits at most


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are set in a bitmap of repeated()."""
    bits = (8 * len(bitmap)).bit_length() - 1
    bit = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def id_bit(column: Column | str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << MOST_ID_BITS))


class Bitmap:
    """A set of ids, as id_bit; what isn't in it may seem to be."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, bit: np.ndarray) -> np.ndarray:
        bit = bit & ((1 << self.bits) - 1)
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1


def _words(df: DataFrame, column: str, n: int | None) -> tuple[int, DataFrame]:
    """(bits, rows (w, b) of 64 bits each, 2^20 at most)."""
    bits = int(np.clip(np.ceil(np.log2(max(1, df.count() if n is None else n))) + 4, ID_BITS, MOST_ID_BITS))
    bit = df.select((id_bit(column) % (1 << bits)).alias("i"))
    return bits, bit.selectExpr("i div 64 w", "shiftleft(1L, cast(i % 64 as int)) b").groupBy("w").agg(F.bit_or("b").alias("b"))


def ids(df: DataFrame, column: str, n: int | None = None) -> Bitmap:
    """The bitmap of the ids in a column; n: how many they are, about."""
    bits, found = _words(df, column, n)
    found = found.collect()  # 2^20 rows at most
    words = np.zeros((1 << bits) // 64, np.int64)
    words[[r["w"] for r in found]] = [r["b"] for r in found]
    return Bitmap(bits, words)


def parted(docs: DataFrame, key: str, some: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key surely isn't in some, the others): only the others need a join.

    The bitmap's words are broadcast: their number is bounded by MOST_ID_BITS.
    """
    bits, words = _words(some, column, None)
    bit = id_bit(F.col(key).cast("long")) % (1 << bits)
    words = F.broadcast(words.toDF("pairlake_w", "pairlake_b"))
    met = docs.join(words, F.floor(bit / 64).cast("long") == F.col("pairlake_w"), "left")
    flag = F.coalesce(F.getbit("pairlake_b", (bit % 64).cast("int")) == 1, F.lit(False))
    own = [docs[c] for c in docs.columns]
    return met.where(~flag).select(*own), met.where(flag).select(*own)
