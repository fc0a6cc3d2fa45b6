"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

Documents link when the sets of their word shingles have a Jaccard similarity of ``percent`` / 100 or
more. Equal texts are one from the start (SHA-256), and texts with the same set are one class (128-bit
digest), so a group of copies of any size costs one member. Shingles are compared by 64-bit hashes; that
two different shingles of a pair agree has a chance of about 1 in 10^13 for documents of 1,000 words.

1. A scan of distinct texts gives each one's set size and digest, and deals their shingle hashes out
   by value: a bitmap of those that two texts have (Repeats), and counts of shingles and words in hash
   buckets (a few MB for each task, whatever the corpus holds). They make the rare-first order:
   shingles of one text first, then by how full their bucket is, then by how frequent their words are.
   Any global order gives right results; a full bitmap or full buckets only make it less sharp.
2. A scan emits the prefix of each set in that order, n - ceil(t n) + 1 shingles, without those that
   no other text has. A text whose prefix is all its own emits nothing. Each entry carries how the
   shingles after it, its suffix, spread over PARTS fixed ranges of hashes.
3. Only shingles that two classes have stay. First each class is paired with some of the classes that
   its shingles lead to, those with few shingles of their own before others, verified and linked; then follow all pairs on
   a shingle whose ends aren't already in one component. So no pair that could join two components is
   left out, but a large group of near copies doesn't emit all its pairs. ``all_links`` verifies those too.
4. Length, positional and suffix filter judge each pair before it is made: two suffixes share no more
   than the smaller of their counts in each range. What is left is verified once, on whole sets.

Null or empty text, or text without words, has an empty set, links with nothing and is its own
component. Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows are in
one component. A null doc_id takes part; components name non-null ids only. A very long text costs
memory in proportion to its words. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written
from .graph import components
from .marks import HELD, Repeats, id_bit, ids, marked, parted

WORDS = 4
PERCENT = 85
#: Buckets of the counts of shingles and of words, and slices that they are added up in.
SHINGLE_BUCKETS, WORD_BUCKETS, SLICES = 1 << 19, 1 << 17, 64
#: A shingle is frequent if its bucket holds so many times the median.
FREQUENT = 2
#: Rounds of pairs with central classes, and pairs of a class in each; all others are left to the last round.
ROUNDS, STARS = 1, 12
#: Words whose hash a worker keeps, and digests that a task remembers.
CACHE = 100_000
#: Bytes of text for each shingle, about.
PER_SHINGLE = 6
#: Odd multipliers of the words of a shingle, and of the final mixing.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Ranges of hashes that the suffix filter counts a suffix in.
PARTS = 16


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _hashed(text: bytes | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of UTF-8 text, hash of each word); bytes.split parts at the ASCII white space meant."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        whole = [xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else []
        return np.array(whole, np.uint64), h
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out ^= out >> np.uint64(31)
        out = (out + h[i : i + n]) * MIX[i % len(MIX)]
    out ^= out >> np.uint64(29)
    return out, h


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(_hashed(text, k)[0])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bit of doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.withColumn("bit", id_bit("doc_id"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


#: Groups of rows of the first scan: buckets of hashes, slices of counts, texts.
COUNTS, TEXTS = 1 << 20, 1 << 21


def _scanned(docs: DataFrame, k: int, kept, expected: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct texts as digest, n, sig: a written table; what the order is made of).

    The order: the bitmap of repeated shingles, a class for each bucket of shingles (0, or how frequent),
    the log count of each bucket of words.
    """
    repeats = Repeats(expected)
    names = ["g", "digest", "n", "sig", "once", "more"]
    schema = "g int, digest binary, n long, sig binary, once binary, more binary"
    none = lambda n, kind: pa.nulls(n, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHINGLE_BUCKETS + WORD_BUCKETS, np.int64)
        held, waiting, at = [], 0, 0

        def deal() -> pa.RecordBatch:
            bucket, once, more = repeats.deal(held)
            n = len(bucket)
            return pa.RecordBatch.from_arrays([bucket, none(n, pa.binary()), none(n, pa.int64()), none(n, pa.binary()), once, more], names=names)

        for batch in small(batches):
            texts, n, sigs = [], [], []
            for t in batch.column(1).filter(pa.array(kept.value.has(batch[2].to_numpy()))):
                text = t.as_py()
                h, w = _hashed(text, k)
                s = np.unique(h)
                texts.append(hashlib.sha256(text or b"").digest())
                n.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                total[:SHINGLE_BUCKETS] += np.bincount(_bucket(s, SHINGLE_BUCKETS), minlength=SHINGLE_BUCKETS) if len(s) > SHINGLE_BUCKETS >> 4 else 0
                if len(s) <= SHINGLE_BUCKETS >> 4:
                    np.add.at(total, _bucket(s, SHINGLE_BUCKETS), 1)
                np.add.at(total, SHINGLE_BUCKETS + _bucket(w, WORD_BUCKETS), 1)
                held.append(s)
                waiting += len(s)
                if waiting >= HELD:
                    yield deal()
                    held, waiting = [], 0
            g = TEXTS + (np.arange(at, at + len(texts)) & ((1 << repeats.bits) - 1))
            at += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), none(len(n), pa.binary()), none(len(n), pa.binary())], names=names)
        if held:
            yield deal()
        parts = pa.array([_packed(x) for x in np.split(total, SLICES)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTS, COUNTS + SLICES), pa.int32()), none(SLICES, pa.binary()), none(SLICES, pa.int64()), none(SLICES, pa.binary()), parts, none(SLICES, pa.binary())], names=names)

    def meet(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        if g >= TEXTS:
            return table
        found = sum(_unpacked(x.as_py()) for x in table["once"]) if g >= COUNTS else None
        found = repeats.meet(table["once"], table["more"]) if found is None else _packed(found)
        one = [none(1, pa.binary()), none(1, pa.int64()), none(1, pa.binary()), pa.array([found], pa.binary()), none(1, pa.binary())]
        return pa.table([table["g"][:1], *one], names=names)

    got = written(_read(docs).mapInArrow(scan, schema).groupBy("g").applyInArrow(meet, schema), "texts")
    parts = {r["g"]: bytes(r["once"]) for r in got.where(F.col("g") < TEXTS).select("g", "once").collect()}  # bounded by the bitmap and the buckets
    width = (SHINGLE_BUCKETS + WORD_BUCKETS) // SLICES
    counts = np.zeros(width * SLICES, np.int64)
    for i in range(SLICES):
        if COUNTS + i in parts:
            counts[i * width : (i + 1) * width] = _unpacked(parts.pop(COUNTS + i))
    one, words = counts[:SHINGLE_BUCKETS], counts[SHINGLE_BUCKETS:]
    frequent = np.log2(np.maximum(1, one / (FREQUENT * max(1.0, float(np.median(one))))))
    order = np.frombuffer(repeats.bitmap(parts), np.uint8), np.ceil(4 * frequent).astype(np.uint8), np.log2(1 + words).astype(np.float32)
    texts = got.where(F.col("g") >= TEXTS).select("digest", "n", "sig").dropDuplicates(["digest"])
    texts = written(texts, "classes")
    dropped(got)
    return texts, order


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, that number first."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def suffixes(s: np.ndarray, before: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each of the chosen places of a set, in order: the counts by range of what comes after it; before comes first."""
    part = (s >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
    left = np.bincount(part, minlength=PARTS) - np.bincount(part[before], minlength=PARTS)
    return left - np.cumsum(part[chosen][:, None] == np.arange(PARTS), 0)


def _prefixes(docs: DataFrame, k: int, percent: int, order: tuple[np.ndarray, ...], kept) -> DataFrame:
    """Rows (token, sig, n, pos, rest) of shingles that may be in another text; pos counts from 1 in the rare-first order."""
    shared = docs.sparkSession.sparkContext.broadcast([x.tobytes() for x in order])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, frequent, common = (np.frombuffer(x, kind) for x, kind in zip(shared.value, (np.uint8, np.uint8, np.float32)))
        seen: set[bytes] = set()
        for batch in small(batches):
            tokens, at, sigs, sizes, rest = [], [], [], [], []
            for t in batch.column(1).filter(pa.array(kept.value.has(batch[2].to_numpy()))):
                h, w = _hashed(t.as_py(), k)
                s, where = np.unique(h, return_index=True)
                n = len(s)
                mark = marked(bitmap, s)
                own = n - int(mark.sum())
                p = n - -(-percent * n // 100) + 1
                if own >= p:  # no text has a shingle of the prefix
                    continue
                sig = xxhash.xxh3_128_digest(s.tobytes())
                if sig in seen:
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                seen.add(sig)
                usual = common[_bucket(w, WORD_BUCKETS)]
                usual = sum(usual[i : i + len(h)] for i in range(k)) if len(w) >= k else usual.sum(keepdims=True)
                some = np.flatnonzero(mark)
                key = 4096 * frequent[_bucket(s[some], SHINGLE_BUCKETS)].astype(np.float64) + usual[where[some]]
                some = some[np.argsort(key, kind="stable")][: p - own]  # ties go by hash, as s is sorted
                tokens.append(s[some].view(np.int64))
                at.append(np.arange(own + 1, own + 1 + len(some), dtype=np.int32))
                rest.append(suffixes(s, ~mark, some))
                sigs.append(sig)
                sizes.append(n)
            if sigs:
                rep = np.repeat(np.arange(len(sigs)), [len(x) for x in at])
                rest = np.concatenate(rest).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(np.arange(0, rest.size + 1, PARTS, dtype=np.int32)), pa.array(rest.ravel()))
                columns = [pa.array(np.concatenate(tokens)), pa.array(sigs, pa.binary()).take(pa.array(rep)), pa.array(np.array(sizes, np.int32)[rep]), pa.array(np.concatenate(at)), rest]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "sig", "n", "pos", "rest"])

    return _read(docs).mapInArrow(scan, "token long, sig binary, n int, pos int, rest array<int>")


def _several(postings: DataFrame) -> DataFrame:
    """The postings of tokens that two classes have."""
    some = postings.dropDuplicates(["token", "sig"])
    several = postings.groupBy("token").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo != hi").select("token")
    return some.join(several, "token")


def _sets(docs: DataFrame, k: int, need: DataFrame) -> DataFrame:
    """(sig, tokens) for the needed (sig, rep): the sets of those documents, read again."""
    shared = docs.sparkSession.sparkContext.broadcast(ids(need, "rep"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            batch = batch.filter(pa.array(shared.value.has(batch[2].to_numpy())))
            sets = [shingles(t.as_py(), k).tobytes() for t in batch[1]]
            sigs = [xxhash.xxh3_128_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "sig", "tokens"])

    found = _read(docs).mapInArrow(scan, "doc_id long, sig binary, tokens binary")
    found = found.join(need, "sig").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    return found.select("sig", "tokens").dropDuplicates(["sig"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            good = []
            for x, y in zip(batch[2], batch[3]):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda k, as_: sets.select(F.col("sig").alias(k), F.col("tokens").alias(as_))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def after(x: Column, y: Column) -> Column:
    """Suffix filter: two suffixes share no more than the smaller of their counts in each range."""
    return sum((F.least(F.get(x, k), F.get(y, k)).cast("long") for k in range(1, PARTS)), F.least(F.get(x, 0), F.get(y, 0)).cast("long"))


def _candidates(x: DataFrame, y: DataFrame, percent: int, extra) -> DataFrame:
    """Pairs (x, y) of postings on one token that pass the length, the positional and the suffix filter."""
    x, y = x.alias("x"), y.alias("y")
    n, m, i, j = (F.col(c).cast("long") for c in ("x.n", "y.n", "x.pos", "y.pos"))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.sig") != F.col("y.sig")) & extra
    on &= 100 * F.least(n, m) >= percent * F.greatest(n, m)
    on &= (100 + percent) * (1 + F.least(n - i, m - j)) >= percent * (n + m)
    on &= (100 + percent) * (1 + after(F.col("x.rest"), F.col("y.rest"))) >= percent * (n + m)
    return x.join(y, on).select(F.col("x.sig").alias("x"), F.col("y.sig").alias("y"))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents as doc_id, digest, bytes; texts as digest, n, sig, rep; classes as sig, rep; postings of shared tokens), all written."""
    rows = written(digests(docs), "digests")
    reps = written(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("bytes").alias("bytes")), "reps")
    total = reps.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    kept = docs.sparkSession.sparkContext.broadcast(ids(reps, "rep", total["n"]))
    texts, order = _scanned(docs, words, kept, total["bytes"] // PER_SHINGLE)
    postings = written(_prefixes(docs, words, percent, order, kept), "postings")
    several = written(_several(postings), "shared")
    full = written(texts.join(reps.select("digest", "rep"), "digest"), "classes")
    classes = written(full.where("n > 0").groupBy("sig").agg(F.min("rep").alias("rep")), "reps")
    dropped(postings, texts, reps)
    return rows, full, classes, several


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as doc_id, digest, bytes; texts as digest, n, sig, rep; components of classes as sig, comp). All are written."""
    rows, texts, classes, labelled = _classes(docs, words, percent)
    labelled = labelled.withColumn("comp", F.col("sig"))
    sets, tested, edges, spent = [], [], [], []
    union = lambda tables: reduce(DataFrame.union, tables)
    for turn in range(ROUNDS + 1):
        stars, x = turn < ROUNDS, labelled
        if stars:
            # a class with few shingles of its own has an early place for shared ones: it is near to most of its group
            place = F.col("pos") if turn % 2 == 0 else F.lit(0)
            one = F.struct(place.alias("place"), F.xxhash64("sig", "token", F.lit(turn)).alias("h"), "sig", "n", "pos", "rest", "comp")
            ends = labelled.groupBy("token").agg(F.array_distinct(F.array(F.min(one), F.max(one))).alias("s"))
            ends = ends.select("token", F.explode("s").alias("s")).select("token", "s.sig", "s.n", "s.pos", "s.rest", "s.comp")
            pairs = _candidates(labelled, ends, percent, F.col("x.comp") != F.col("y.comp"))
            some = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("y", F.lit(turn)).alias("h"), "y"))), 1, STARS)  # of a class's own shingles
            pairs = pairs.distinct().groupBy("x").agg(some.alias("y")).select("x", F.explode("y").alias("y")).select("x", "y.y")
        else:
            pairs = _candidates(x, x, percent, (F.col("x.sig") < F.col("y.sig")) & (F.col("x.comp") != F.col("y.comp")))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tested:
            pairs = pairs.join(union(tested), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tested.append(pairs)
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        if sets:
            ends = ends.join(union(sets).select("sig"), "sig", "left_anti")
        need = written(classes.join(ends, "sig"), "need")
        sets.append(written(_sets(docs, words, need), "sets"))
        edges.append(written(_verified(pairs, union(sets), percent), "edges"))
        comps = components(union(edges)).withColumnsRenamed({"node": "sig", "component": "comp"})
        spent.append(need)
        if stars:  # only tokens that part components still can link any
            now = written(labelled.drop("comp").join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "labelled")
            across = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
            labelled = written(now.join(across, "token"), "labelled")
            spent += [now, labelled]
    dropped(*spent, *sets, *tested, *edges, classes)
    return rows, texts, comps


def _members(texts: DataFrame, comps: DataFrame) -> DataFrame:
    """Texts as digest, n, comp (null without words)."""
    return texts.join(comps, "sig", "left").select("digest", "n", "rep", F.when(F.col("n") > 0, F.coalesce("comp", "sig")).alias("comp"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, texts, comps = links(docs, words, percent)
    of = _members(texts, comps)
    least = of.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    of = of.join(least, "comp", "left").select("digest", "n", "least")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return rows.join(of, "digest").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def all_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, n_shingles, class, n_links; links between classes as a, b).

    Every candidate pair of classes is verified, also within a component: as many as there are links may
    be needed. n_links counts other rows that a row links with, those of its own class too.
    """
    rows, texts, classes, labelled = _classes(docs, words, percent)
    pairs = _candidates(labelled, labelled, percent, F.col("x.sig") < F.col("y.sig"))
    pairs = written(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    sets = written(_sets(docs, words, written(classes.join(ends, "sig"), "need")), "sets")
    edges = written(_verified(pairs, sets, percent), "edges")
    copies = rows.groupBy("digest").count().join(texts, "digest").where("n > 0").groupBy("sig").agg(F.sum("count").alias("copies"))
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("sig", "other")
    far = both.join(copies.toDF("other", "there"), "other").groupBy("sig").agg(F.sum("there").alias("there"))
    count = copies.join(far, "sig", "left").select("sig", (F.col("copies") - 1 + F.coalesce("there", F.lit(0))).alias("n_links"))
    of = texts.join(count, "sig", "left").select("digest", F.col("n").alias("n_shingles"), F.col("sig").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(of, "digest").select("doc_id", "n_shingles", "class", "n_links"), edges


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates: of each component the document with the smallest doc_id stays.

    Where rows with different texts of a component share that doc_id, the text with the smallest digest stays;
    where rows repeat doc_id and text, the one whose columns have the smallest hash. Rows without words are
    no duplicates and stay, and so do rows with a null doc_id.
    """
    rows, texts, comps = links(docs, words, percent)
    of = _members(texts, comps).where("comp is not null").select("digest", "comp")
    rows = rows.where("doc_id is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("rows"))
    rows = written(rows.join(of, "digest"), "members")
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    rows = rows.join(first, "comp").withColumn("stays", (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.digest") == F.col("digest")))
    odd = written(rows.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias("pairlake_id"), F.col("digest").alias("pairlake_digest"), "stays"), "odd")
    sure, others = parted(docs, "doc_id", odd, "pairlake_id")
    on = (others["doc_id"].cast("long") == odd["pairlake_id"]) & (_digest(others["text"]) == odd["pairlake_digest"])
    met = others.join(odd, on, "left")
    plain = met.where("stays is null").select(*(others[c] for c in docs.columns))
    again = met.where("stays").select("pairlake_id", "pairlake_digest", F.struct(*(others[c] for c in docs.columns)).alias("pairlake_row"))
    again = again.groupBy("pairlake_id", "pairlake_digest").agg(F.min_by("pairlake_row", F.xxhash64("pairlake_row")).alias("pairlake_row"))
    return sure.union(plain).union(again.select("pairlake_row.*"))
