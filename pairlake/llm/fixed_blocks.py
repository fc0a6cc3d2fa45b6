"""Exact removal of repeated passages of words, by fixed blocks as anchors.

A word is removed if a window of ``length`` words that covers it also starts in a document with a smaller
doc_id. Words are compared unchanged; windows never cross documents and are judged on the input.

0. Whole copies. A document whose text a smaller doc_id has is removed whole and not looked at again.
1. Index. Every document is cut into non-overlapping blocks of half a window; each window holds one whole
   block of its own document.
2. Probe. One scan rolls over every window of a block's length, and deals the hashes out by ranges, those of blocks
   apart. A block that another document has too, at any place, is marked: a repeated window holds a marked block in
   both of its documents. Only marked blocks go into the Bloom filter that is sent to the tasks.
3. Extend. A second scan cuts the text around each marked block, as far as windows that hold it reach; of
   several blocks in a window the least hash counts, so equal windows are cut alike. Equal cuttings are one
   content with its smallest doc_id, by a hash of 128 bits; only contents that share a block with a different one
   are looked into. There a hit grows by whole words to the left and right as long as some earlier content has the same
   words, by equality of the grown window (its hash of 128 bits) and not pair by pair: a block in very many contents makes no pairs.
4. Occurrences join contents; a document's grown windows that touch or overlap are its maximal repeats.

A false bit of a filter lets more through and never changes a result. A filter has 2^MOST_BITS bits at most.

Null text has no words. A document with a null doc_id keeps all its words and removes none elsewhere. Rows that
repeat a doc_id don't count against each other, also where their texts differ. Very long texts go through in slices, very long words are
compared by their digests. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written
from .marks import HELD, Bitmap, Repeats, id_bit, ids, parted
from .substrings import _joined as joined
from .substrings import _later as later_copies

LENGTH = 13
#: Bits of a filter as powers of two, bits for each hash (at least, below the most).
BITS, MOST_BITS, PER_HASH = 18, 28, 12
#: One block of so many is marked, about.
REPEATED = 4
#: Bytes of a slice of a text (about), rows and bytes that go out at once, contents that a task remembers, bytes of a word that is compared whole.
SLICE, ROWS, BYTES, KNOWN, WORD = 1 << 20, 20_000, 2_000_000, 100_000, 64
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
TURNS = np.array([1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def block_of(length: int) -> int:
    """The longest block of which every window holds a whole one, wherever blocks begin."""
    return (length + 1) // 2


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = end.start() if end else len(text)
        yield text[at:end].split()
        at = end


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers of 0, 1, ... by modulus 2^64, and their inverses."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full((1 << bits) - 1, x, np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word, by sums of all bytes up to its ends: no word is looked at alone."""
    b = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, SPACES[b], True]))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(max(18, len(b).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return start, h ^ (h >> np.uint64(29))


def rolled(x: np.ndarray, block: int) -> np.ndarray:
    """Hashes of so many words on from each, of the words' hashes."""
    have = 1
    while have < block:  # hashes of 2, 4 ... words, the last two overlap
        step = min(have, block - have)
        x = joined(x, step)
        have += step
    return x ^ (x >> np.uint64(29))


def stretches(text: bytes, length: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first word, words, hash of each block that begins there) of stretches that share no window and miss none."""
    at, rest = 0, []
    for words in pieces(text):
        rest += words
        if len(rest) >= length:
            yield at, rest, rolled(hashed(b" ".join(map(bounded, rest)))[1], block_of(length))
            at += len(rest) - length + 1
            rest = rest[len(rest) - length + 1 :]


def windows(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]]:
    """(which text, which word, hash of the block that begins there, words) of texts that hold a window, many short ones at once.

    A text's blocks come in order; those of a long text, or one of long words, come stretch by stretch, with the stretch's words.
    """
    block = block_of(length)

    def together(lot: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]]:
        own = [texts[i] for i in lot]
        start, h = hashed(b" ".join(own))
        edge = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in own)]))
        n = np.diff(edge)
        far = np.zeros(len(lot), bool)
        if len(start):
            size = np.diff(np.r_[start, sum(map(len, own)) + len(own)])  # with the space after it
            far[np.repeat(np.arange(len(lot)), n)[size > WORD]] = True
        for i in np.flatnonzero(far).tolist():
            yield from apart(lot[i])
        if len(h) < block:
            return
        of = np.repeat(np.arange(len(lot)), n)
        good = np.repeat((n >= length) & ~far, n)
        good = good[: len(h) - block + 1] & (of[block - 1 :] == of[: len(h) - block + 1])
        at = np.arange(len(h)) - np.repeat(edge[:-1], n)
        yield np.array(lot)[of[: len(good)][good]], at[: len(good)][good], rolled(h, block)[good], None

    def apart(i: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]]:
        for at, words, x in stretches(texts[i], length):
            yield np.full(len(x), i), np.arange(at, at + len(x)), x, words

    lot, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > SLICE >> 3:
            yield from apart(i)
            continue
        lot.append(i)
        size += len(text) + 1
        if size > SLICE >> 3:
            yield from together(lot)
            lot, size = [], 0
    if lot:
        yield from together(lot)


class Filter:
    """Bloom filters of 64-bit hashes by ranges of them; a hash's 32 bits after the range's own give a bit for each of TURNS."""

    def __init__(self, expected: int, dealt: int = 0):
        self.dealer = Repeats(max(expected, dealt))
        size = int(np.clip(np.ceil(np.log2(max(1, expected) * PER_HASH)), BITS, MOST_BITS))
        self.bits, self.inner = self.dealer.bits, size - self.dealer.bits

    def place(self, rest: np.ndarray, turn: np.uint32) -> np.ndarray:
        """A bit of each hash within its range."""
        spread = (rest ^ (rest >> np.uint32(15))) * turn
        return (spread ^ (spread >> np.uint32(13))) * TURNS[1] >> np.uint32(32 - self.inner)

    def packed(self, rest: np.ndarray) -> bytes:
        mark = np.zeros(1 << self.inner, bool)
        for turn in TURNS:
            mark[self.place(rest, turn)] = True
        return np.packbits(mark).tobytes()

    def deal(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
        """(bucket, hashes of blocks, other hashes, hashes that several texts have) of (hash, text, whether it is a block)."""
        x, of, own = map(np.concatenate, zip(*held))
        order = np.argsort(x)
        x, of, own = x[order], of[order], own[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        own, both = np.logical_or.reduceat(own, first), x[first] >> np.uint64(32 - self.bits)
        ends = np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(32)
        parts = [np.split(y.astype(np.uint32), np.searchsorted(y, ends)) for y in (both[own], both[~own], both[several])]
        return [pa.array(range(1 << self.bits), pa.int32()), *(pa.array([y.tobytes() for y in p], pa.binary()) for p in parts)]

    def meet(self, table: pa.Table) -> pa.Table:
        """A range's filter: of the blocks that came more than once."""
        own, others, more = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table[name]]) for name in ("own", "others", "more"))
        every = np.sort(np.concatenate([own, others]))
        twice = np.concatenate([every[1:][every[1:] == every[:-1]], more])
        bits = self.packed(np.intersect1d(own, twice))
        return pa.table({"bucket": table["bucket"][:1], "bits": pa.array([bits], pa.binary())})

    def has(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be in a filter."""
        both = hashes >> np.uint64(32 - self.bits)
        begin, rest = (both >> np.uint64(32)).astype(np.int64) << self.inner, both.astype(np.uint32)
        out, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
        for turn in TURNS:  # most hashes that aren't there go with the first bit
            bit = begin[left] + self.place(rest[left], turn)
            left = left[(words[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
        out[left] = True
        return out


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (a hash of the text, which tells rows of one doc_id apart), bit of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("row"), id_bit("doc_id").alias("bit"))


def _own(batches: Iterator[pa.RecordBatch], kept: Bitmap) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """doc_ids, texts and rows of batches, without nulls and without what isn't in the bitmap of ids to look at."""
    for batch in small(batches):
        good = kept.has(batch[3].to_numpy()) & batch[0].is_valid().to_numpy(False) & batch[1].is_valid().to_numpy(False)
        batch = batch.filter(pa.array(good))
        yield batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()


def _marked(docs: DataFrame, length: int, kept: Broadcast, filter: Filter) -> np.ndarray:
    """The filter of blocks of one document that another one has too, at any place."""
    block, names = block_of(length), ["bucket", "own", "others", "more"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, before = [], 0, 0
        for _, texts, _ in _own(batches, kept.value):
            for of, at, x, _ in windows(texts, length):
                held.append((x, of + before, at % block == 0))
                n += len(x)
                if n >= HELD:
                    yield pa.RecordBatch.from_arrays(filter.deal(held), names=names)
                    held, n = [], 0
            before += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays(filter.deal(held), names=names)

    met = _read(docs).mapInArrow(scan, "bucket int, own binary, others binary, more binary").groupBy("bucket").applyInArrow(lambda table: filter.meet(table), "bucket int, bits binary")
    met = written(met, "filters")
    out = np.zeros((1 << filter.bits, max(1, (1 << filter.inner) // 8)), np.uint8)
    for r in met.toLocalIterator():  # 2^MOST_BITS bits at most
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    dropped(met)
    return out.ravel()


def bounded(word: bytes) -> bytes:
    """The word, or a digest that no word can be where it is very long."""
    return word if len(word) <= WORD else b"\x09" + hashlib.sha256(word).hexdigest().encode()


def cuttings(x: np.ndarray, marked: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(first window, windows, anchor) of runs of windows whose least marked block is the same."""
    block = block_of(length)
    width = length - block + 1
    y = np.where(marked, x, np.iinfo(np.uint64).max)
    have = 1
    while have < width:
        step = min(have, width - have)
        y = np.minimum(y[:-step], y[step:])
        have += step
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    end = np.r_[first[1:], len(y)]
    good = y[first] != np.iinfo(np.uint64).max
    anchor = y[first].view(np.int64)
    return [(s, min(e - s, width), a) for b, e, a in zip(first[good].tolist(), end[good].tolist(), anchor[good].tolist()) for s in range(b, e, width)]


#: cid is a hash of the content; start is the first window; content is null in occurrences, start in contents.
CUTTINGS = "anchor long, cid binary, doc_id long, row long, start long, windows int, content binary"


def _cut(docs: DataFrame, length: int, shared: Broadcast, kept: Broadcast, filter: Filter) -> DataFrame:
    names = [x.split()[0] for x in CUTTINGS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}  # the smallest doc_id that a content went out with
        rows: list[tuple] = []
        size = 0
        for docs, texts, turns in _own(batches, kept.value):
            for of, at, x, words in windows(texts, length):
                marked = filter.has(shared.value, x)
                here = np.unique(of[marked])
                for i, lo, hi in zip(here.tolist(), np.searchsorted(of, here).tolist(), np.searchsorted(of, here, "right").tolist()):
                    doc, row, first = docs[i], turns[i], int(at[lo])
                    own = texts[i].split() if words is None else list(map(bounded, words))
                    for s, n, anchor in cuttings(x[lo:hi], marked[lo:hi], length):
                        content = b" ".join(own[s : s + n + length - 1])
                        cid = xxhash.xxh3_128_digest(content)
                        rows.append((None, cid, doc, row, first + s, n, None))
                        if least.get(cid, doc + 1) > doc:
                            if len(least) >= KNOWN:
                                least.clear()
                            least[cid] = doc
                            rows.append((anchor, cid, doc, None, None, n, content))
                            size += len(content)
                        if len(rows) >= ROWS or size >= BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _read(docs).mapInArrow(scan, CUTTINGS)


def _decided(contents: DataFrame, length: int) -> DataFrame:
    """cid, least (doc_id), mask: bits of the content's windows that another content has in a document before least."""
    none = F.lit(0).cast("long").alias("mask")
    several = written(contents.groupBy("anchor").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select(F.col("anchor").alias("of")), "several")
    alone, others = parted(contents, "anchor", several, "of")
    alone = alone.groupBy("cid").agg(F.min("doc_id").alias("least")).select("cid", "least", none)
    others = written(others.groupBy("cid", "windows").agg(F.min("doc_id").alias("least"), F.max("content").alias("content")), "contents")
    words = F.split(F.col("content").cast("string"), " ", -1)
    grown = others.withColumn("words", words).select("cid", "least", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("at"), "words")
    window = F.array_join(F.slice("words", F.col("at") + 1, length), " ")
    one, other = (F.xxhash64(F.lit(seed), window).alias(name) for seed, name in ((1, "one"), (2, "other")))
    grown = grown.select("cid", "least", "at", one, other)  # 128 bits, as contents have
    first = grown.groupBy("one", "other").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("one", "other", "first")
    bits = grown.join(first, ["one", "other"]).where("first < least").groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    return alone.union(others.join(bits, "cid", "left").select("cid", "least", F.coalesce("mask", F.lit(0).cast("long"))))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row (xxhash64 of the text), found: (start, mask) of windows from word start that start in an earlier document; a mask of -1 is the whole text.

    A written table of documents that have any.
    """
    if not 3 <= length <= 120:
        raise ValueError(f"length must be from 3 to 120 words: {length}")
    later = written(later_copies(docs, 2 * length - 1), "later")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n")).where("doc_id is not null")
    total = every.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    kept = docs.sparkSession.sparkContext.broadcast(ids(every.join(later, "doc_id", "left_anti"), "doc_id", total["docs"]))
    filter = Filter(total["n"] // (6 * block_of(length) * REPEATED), total["n"] // 6)  # some six bytes a word
    marks = docs.sparkSession.sparkContext.broadcast(_marked(docs, length, kept, filter))
    cut = written(_cut(docs, length, marks, kept, filter), "cuttings")
    marks.destroy()
    decided = _decided(cut.where("content is not null").select("anchor", "cid", "doc_id", "windows", "content"), length)
    seen = cut.where("content is null").select("cid", "doc_id", "row", "start", "windows")
    whole = F.expr("shiftleft(1L, windows) - 1")
    seen = seen.join(decided, "cid").withColumn("mask", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.col("mask"))).where("mask <> 0")
    gone = later.join(_read(docs).select("doc_id", "row"), "doc_id").select("doc_id", "row", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("mask"))
    found = seen.select("doc_id", "row", "start", "mask").union(gone).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "mask")).alias("found"))  # a document's own
    found = written(found, "repeats")
    dropped(cut, later)
    return found


def removal(found: list[dict], n: int, length: int) -> np.ndarray:
    """Which of n words go."""
    if any(f["mask"] == -1 for f in found):
        return np.full(n, n >= length)
    gone = np.zeros(n + 1, np.int64)
    for f in found:
        for i in range(f["mask"].bit_length()):
            if f["mask"] >> i & 1:
                gone[f["start"] + i] += 1
                gone[f["start"] + i + length] -= 1
    return np.cumsum(gone[:-1]) > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>"


def removed(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (maximal removed runs as [first word, end)), and with texts the kept text."""
    found = repeats(docs, length)
    schema = RESULT + ", kept string" * texts
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))] + [pa.string()] * texts

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in kinds]
            for text, own in zip(batch[1], batch[2]):
                text, h, n, parts, runs = text.as_py() or b"", hashlib.sha256(), 0, [], []
                gone = removal(own.as_py(), sum(map(len, pieces(text))), length) if own.is_valid else None
                glue = b""
                for words in pieces(text):
                    kept = words if gone is None else [w for w, g in zip(words, gone[n : n + len(words)].tolist()) if not g]
                    n += len(words)
                    if kept:
                        part = glue + b" ".join(kept)
                        h.update(part)
                        glue = b" "
                        if texts:
                            parts.append(part)
                if gone is not None:
                    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                    runs = edge.reshape(-1, 2).tolist()
                for column, v in zip(out, (n, sum(e - s for s, e in runs), h.hexdigest(), runs, *([b"".join(parts).decode()] * texts))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, k) for c, k in zip(out, kinds))], names=[x.split()[0] for x in schema.split(", ")])

    rows = _read(docs).select("doc_id", "text", "row")
    some = found.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "found")
    sure, others = parted(rows, "doc_id", some, "of")  # only texts that may have repeats travel
    others = others.join(some, (F.col("doc_id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left").select("doc_id", "text", "found")
    sure = sure.select("doc_id", "text", F.lit(None).cast("array<struct<start:long,mask:long>>").alias("found"))
    return others.mapInArrow(digest, schema).union(sure.mapInArrow(digest, schema))
