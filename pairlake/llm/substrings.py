"""Exact substring dedup: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a
smaller doc_id. Texts are UTF-8 bytes; matches never cross documents, and strings are judged on the
input.

0. Whole copies. A document whose text a smaller doc_id has is removed whole and not looked at again:
   nothing starts in it first. What is looked at is a bitmap of ids, so a false bit looks at a copy too.
1. Anchors. Each window of ``length`` bytes selects the least hash of its strings of five eighths of that (winnowing),
   so equal windows select equal anchors. A scan collects each document's anchors; those in two
   documents or more are marked in a bitmap. A false mark costs work, never results.
2. Fragments. A second scan cuts every run of windows that share a marked anchor. Equal fragments are
   one interval from the start (by hash, beside their anchor's): one content with its smallest doc_id.
   Occurrences are kept apart, so copies cost nothing in step 3 and no task holds the documents of a passage.
3. Merge. Contents meet by anchor; an anchor of more contents than a group takes is dealt out by
   single windows instead, so no group follows the corpus. In each group of anchors, the contents of
   each shard get a Burrows-Wheeler transform (two-byte symbols, rotations of fragments), and the
   transforms are merged by interleave refinement: every round deals the interleave out by the symbols
   that the transforms give in that order, which sorts all suffixes by two symbols more, without sorting
   suffixes of different shards against each other. The round in which a bound between two suffixes
   appears is the length of their common prefix; between bounds of ``length`` or more lie the repeated
   intervals.
4. Each interval's smallest doc_id decides; occurrences join contents, and documents their spans.

Null text is empty. A document with a null doc_id keeps all its bytes and removes none elsewhere.
Rows that repeat a doc_id don't count against each other. Very long texts go through in slices of
windows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small, written
from .marks import Bitmap, id_bit, ids, marked, parted, repeated

LENGTH = 50
#: Contents of a group and of an anchor at most (about), shards of a merge, bytes for each anchor of a text (about).
PER_GROUP, SHARDS, PER_ANCHOR = 10_000, 16, 8
#: Crowded anchors that may go to every task; more are joined.
BROADCAST = 100_000
#: Windows of a text that are looked at at once; fragments and their bytes that go out at once; contents that a task remembers.
SLICE, ROWS, BYTES, KNOWN = 500_000, 20_000, 2_000_000, 100_000
#: Odd multipliers.
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _joined(x: np.ndarray, step: int) -> np.ndarray:
    y = x[:-step] * A
    y += x[step:]
    y *= B
    y ^= y >> np.uint64(31)
    return y


def gram(length: int) -> int:
    """Bytes of an anchor: long enough that few are shared by chance, short enough that windows share them with their neighbours."""
    return 5 * length // 8


def anchors(text: bytes, length: int = LENGTH) -> np.ndarray:
    """For each window of ``length`` bytes, the least hash of the strings of gram(length) bytes in it."""
    if len(text) < length:
        return np.empty(0, np.uint64)
    x = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * B
    have, size = 1, gram(length)
    while have < size:  # hashes of 2, 4, 8 ... bytes, the last two overlap
        step = min(have, size - have)
        x = _joined(x, step)
        have += step
    width, have = length - size + 1, 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x * A  # least hashes are small: spread over all values again, which is one to one


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _later(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, n) of documents of n bytes whose whole text a smaller doc_id has; not of a doc_id with several rows."""
    n = F.octet_length("text").cast("long")
    info = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), n.alias("n"))
    info = written(info.where((F.col("n") >= length) & F.col("doc_id").isNotNull()), "digests")
    first = info.groupBy("digest").agg(F.min("doc_id").alias("first"))
    once = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count = 1")
    return info.join(first, "digest").where("doc_id > first").select("doc_id", "n").join(once, "doc_id", "left_semi")


def _own(batches: Iterator[pa.RecordBatch], kept: Bitmap) -> Iterator[tuple[int, bytes]]:
    """(doc_id, text), without nulls and without what isn't in the bitmap of ids to look at."""
    for batch in small(batches):
        batch = batch.filter(pa.array(kept.has(batch[2].to_numpy())))
        for d, t in zip(batch[0].to_pylist(), batch[1]):
            if d is not None and t.is_valid:
                yield d, t.as_py()


def _slices(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window, anchors of windows from there) of a text."""
    for at in range(0, max(0, len(text) - length + 1), SLICE):
        yield at, anchors(text[at : at + SLICE + length - 1], length)


def _marks(docs: DataFrame, length: int, kept: Broadcast, expected: int) -> bytes:
    """The bitmap of anchors that two documents have."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, text in _own(batches, kept.value):
            for _, x in _slices(text, length):
                yield np.unique(x[np.flatnonzero(np.r_[True, x[1:] != x[:-1]])])

    return repeated(_read(docs).withColumn("bit", id_bit("doc_id")), hashes, expected)


#: anchor is the first half of its hash, cid a hash of the content; place is start * 2^20 + windows.
FRAGMENTS = "anchor int, cid long, doc_id long, place long, shard int, content binary"
MOST, MOST_ID = 1 << 20, 1 << 63


def _fragments(docs: DataFrame, length: int, marks: bytes, kept: Broadcast) -> DataFrame:
    """Occurrences of runs of windows with a marked anchor; the first of a content, in a task, has it (shard isn't null)."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        shard = TaskContext.get().partitionId() % SHARDS
        names = [x.split()[0] for x in FRAGMENTS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        least: dict[int, int] = {}  # the smallest doc_id that a content went out with
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # anchor, doc_id and place
        cids: list[int] = []
        contents: list[bytes | None] = []
        size = 0

        def batch() -> pa.RecordBatch:
            anchor, doc, place = (np.concatenate(c) for c in zip(*parts))
            content = pa.array(contents, pa.binary())
            own = pa.array(np.full(len(cids), shard, np.int32), mask=content.is_null().to_numpy(zero_copy_only=False))
            cid = (np.array(cids, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((anchor, cid, doc, place, own, content), kinds)], names=names)

        for doc, text in _own(batches, kept.value):
            for at, x in _slices(text, length):
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                hit = np.flatnonzero(marked(bitmap, x[first]))
                start, end = first[hit], np.r_[first[1:], len(x)][hit]
                for some in range(0, len(hit), ROWS):
                    s, e = start[some : some + ROWS], end[some : some + ROWS]
                    parts.append(((x[s] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(s), doc, np.int64), (s + at) * MOST + e - s))
                    for content in [text[i:j] for i, j in zip((s + at).tolist(), (e + at + length - 1).tolist())]:
                        cid = xxhash.xxh3_64_intdigest(content)
                        cids.append(cid)
                        if least.get(cid, MOST_ID) > doc:
                            if len(least) >= KNOWN:
                                least.clear()
                            least[cid] = doc
                            size += len(content)
                            contents.append(content)
                        else:
                            contents.append(None)
                    if len(cids) >= ROWS or size >= BYTES:
                        yield batch()
                        parts, cids, contents, size = [], [], [], 0
        if cids:
            yield batch()

    return _read(docs).withColumn("bit", id_bit("doc_id")).mapInArrow(scan, FRAGMENTS)


class Shard:
    """Fragments as rotations in order of their first 64 bytes at least, and the two bytes before each."""

    def __init__(self, contents: list[bytes], length: int):
        text = np.frombuffer(b"".join(contents), np.uint8)
        size = np.array([len(c) for c in contents], np.int64)
        self.of = np.repeat(np.arange(len(contents)), size)
        begin = (np.cumsum(size) - size)[self.of]
        self.at = np.arange(len(text)) - begin
        size = size[self.of]
        turn = lambda k: begin + (self.at + k) % size
        symbol = text.astype(np.uint16) << np.uint16(8) | text[turn(1)]
        double = symbol.astype(np.uint32) << np.uint32(16) | symbol[turn(2)]
        key, depth = double.astype(np.uint64) << np.uint64(32) | double[turn(4)], 8
        while depth < length + 4:
            _, rank = np.unique(key, return_inverse=True)
            key, depth = rank * (rank.max(initial=0) + 1) + rank[turn(depth)], 2 * depth
        self.order = np.argsort(key)
        self.before, self.double = symbol[turn(-2)][self.order], double[turn(-4)][self.order]


def merged(shards: list[Shard], length: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(interleave: whose suffix stands where; common: bytes that each suffix has in common with the one before it).

    The k-th entry of a shard in the interleave is the k-th suffix in that shard's own order. Common
    prefixes count whole symbols and are not followed beyond ``length``. wide: two symbols are taken for
    one, where their kinds are few enough.
    """
    who = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    before = np.concatenate([s.before for s in shards])
    double, step = before, 2
    if wide:
        kinds, of = np.unique(np.concatenate([s.double for s in shards]), return_inverse=True)
        if len(kinds) <= 1 << 16:  # what a radix sort takes
            double, step = of.astype(np.uint16), 4
    common = np.full(len(who), length, np.int32)
    common[:1] = 0
    block, blocks, depth = np.zeros(len(who), np.int32), 1, 0
    while depth < length:
        now = 2 if (length - depth) % step else step  # an odd symbol comes first
        symbol = np.empty(len(who), np.uint16)
        symbol[np.argsort(who, kind="stable")] = double if now == step else before
        deal = np.argsort(symbol, kind="stable")
        who, symbol, block = who[deal], symbol[deal], block[deal]
        new = np.flatnonzero((symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])) + 1
        common[new] = np.minimum(common[new], depth)  # a bound stays once it is there
        depth += now
        if len(new) + 1 == blocks and now == step:  # no block was parted, so none will be
            break
        blocks = len(new) + 1
        block = np.zeros(len(who), np.int32)
        block[new] = 1
        block = np.cumsum(block, dtype=np.int32)
    return who, common


def earlier(contents: list[bytes], docs: np.ndarray, shard: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each content, the runs (first window, windows) that another content has in an earlier document."""
    ids = np.unique(shard)
    own = [np.flatnonzero(shard == s) for s in ids]
    parts = [Shard([contents[i] for i in x], length) for x in own]
    who, common = merged(parts, length, wide=True)
    block = np.cumsum(common < length) - 1  # the repeated intervals
    least = np.full(int(block[-1]) + 1, np.iinfo(np.int64).max)
    found = []
    size = np.array([len(c) for c in contents])
    for k, (part, mine) in enumerate(zip(parts, own)):
        content = mine[part.of[part.order]]
        at = part.at[part.order]
        b = block[who == k]
        good = at + length <= size[content]
        content, at, b = content[good], at[good], b[good]
        np.minimum.at(least, b, docs[content])
        found.append((content, at, b))
    runs: list[list[tuple[int, int]]] = [[] for _ in contents]
    content, at, b = (np.concatenate(x) for x in zip(*found))
    hit = least[b] < docs[content]
    content, at = content[hit], at[hit]
    if len(content):
        o = np.lexsort((at, content))
        content, at = content[o], at[o]
        cut = np.flatnonzero(np.r_[True, (content[1:] != content[:-1]) | (at[1:] != at[:-1] + 1)])
        for s, e in zip(cut, np.r_[cut[1:], len(at)]):
            runs[content[s]].append((int(at[s]), int(e - s)))
    return runs


def _decided(fragments: DataFrame, length: int) -> DataFrame:
    """anchor, cid, least (doc_id), runs of windows that are earlier elsewhere."""
    contents = fragments.where("shard is not null")
    groups = max(1, -(-contents.count() // PER_GROUP))
    kind = pa.list_(pa.struct([("at", pa.int64()), ("windows", pa.int64())]))

    def decide(table: pa.Table) -> pa.Table:
        cid, docs, anchor = table["cid"].to_numpy(), table["doc_id"].to_numpy(), table["anchor"].to_numpy()
        order = np.lexsort((docs, cid, anchor))
        new = np.r_[True, (cid[order][1:] != cid[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]
        keep = order[new]  # of equal contents the one with the smallest doc_id
        _, inverse, n = np.unique(anchor[keep], return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[inverse] > 1)  # an anchor with one content has nothing to merge
        runs: list[list[tuple[int, int]]] = [[] for _ in keep]
        if len(several):
            some = keep[several]
            found = earlier(table["content"].take(pa.array(some)).to_pylist(), docs[some], table["shard"].to_numpy()[some], length)
            for i, r in zip(several, found):
                runs[i] = r
        rows = [[{"at": a, "windows": w} for a, w in r] for r in runs]
        return pa.table({"anchor": anchor[keep], "cid": cid[keep], "least": docs[keep], "runs": pa.array(rows, kind)})

    schema = "anchor int, cid long, least long, runs array<struct<at:long,windows:long>>"
    stats = written(contents.groupBy("anchor").agg(F.count("*").alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi")), "anchors")
    # an anchor with one content has nothing to merge: its bytes needn't travel
    alone, others = parted(contents, "anchor", stats.where("lo <> hi").select(F.col("anchor").cast("long").alias("of")), "of")
    none = F.array().cast("array<struct<at:long,windows:long>>")
    alone = alone.groupBy("anchor", "cid").agg(F.min("doc_id").alias("least")).withColumn("runs", none)
    crowded = written(stats.where(F.col("n") > PER_GROUP).select(F.col("anchor").alias("of")), "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST else crowded.hint("merge")
    own = others.join(crowded, F.col("anchor") == F.col("of"), "left_anti").select("anchor", "cid", "doc_id", "shard", "content", F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("g"))
    usual = alone.union(own.groupBy("g").applyInArrow(decide, schema))
    # a crowded anchor's contents by single windows: equal windows are one interval, as equal fragments are
    some = others.join(crowded, F.col("anchor") == F.col("of"), "left_semi").groupBy("anchor", "cid").agg(F.min("doc_id").alias("least"), F.max("content").alias("content"))
    some = some.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("content") - length)))
    some = some.withColumn("window", F.substring("content", F.col("at") + 1, F.lit(length))).drop("content")
    first = some.groupBy("window").agg(F.min("least").alias("first"))
    hit = F.when(F.col("first") < F.col("least"), F.struct(F.col("at").cast("long").alias("at"), F.lit(1).cast("long").alias("windows")))
    return usual.union(some.join(first, "window").groupBy("anchor", "cid").agg(F.min("least").alias("least"), F.collect_list(hit).alias("runs")))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, spans (array of [start, end) byte offsets to remove, maximal and in order), of documents that have any."""
    if length % 2 or length < 16:
        raise ValueError(f"length must be even and 16 at least: {length}")
    later = written(_later(docs, length), "later")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n")).where("doc_id is not null")
    total = every.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    kept = docs.sparkSession.sparkContext.broadcast(ids(every.join(later, "doc_id", "left_anti"), "doc_id", total["docs"]))
    marks = _marks(docs, length, kept, total["n"] // PER_ANCHOR)
    fragments = written(_fragments(docs, length, marks, kept), "fragments")
    decided = _decided(fragments, length)
    seen = fragments.select("anchor", "cid", "doc_id", "place")
    start, windows = F.shiftright("place", 20), F.col("place") % MOST
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), windows.alias("windows")))
    runs = F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.col("runs"))
    hits = seen.join(decided, ["anchor", "cid"]).select("doc_id", start.alias("start"), F.explode(runs).alias("r"))
    hits = hits.select("doc_id", (F.col("start") + F.col("r.at")).alias("s"), (F.col("start") + F.col("r.at") + F.col("r.windows") + (length - 1)).alias("e"))
    hits = hits.union(later.select("doc_id", F.lit(0).cast("long"), "n"))
    in_order = Window.partitionBy("doc_id").orderBy("s")
    reach = F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)
    cut = hits.withColumn("reach", reach).withColumn("run", F.sum(begins).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.groupBy("doc_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cut = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))  # a document's own
    found = written(cut.select("doc_id", F.transform("spans", lambda x: F.array(x["s"], x["e"])).alias("spans")), "spans")
    dropped(fragments, later)
    return found


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans."""
    cut = spans(docs, length).withColumnRenamed("doc_id", "of")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], []]
            for text, gone in zip(batch[1], batch[2]):
                text, gone = text.as_py() or b"", gone.as_py() or []
                h, at = hashlib.sha256(), 0
                for s, e in gone:
                    h.update(text[at:s])
                    at = e
                h.update(text[at:])
                for column, v in zip(out, (len(text), sum(e - s for s, e in gone), len(gone), h.hexdigest())):
                    column.append(v)
            arrays = [batch[0], *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), batch[2]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    shared = docs.sparkSession.sparkContext.broadcast(ids(cut, "of"))

    def only(flagged: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                yield batch.filter(pa.array(shared.value.has(batch[2].to_numpy()) == flagged)).select([0, 1])

        return _read(docs).withColumn("bit", id_bit("doc_id")).mapInArrow(scan, "doc_id long, text binary")

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    some = only(True)  # only texts that may have spans travel
    some = some.join(cut, some["doc_id"] == cut["of"], "left").select("doc_id", "text", "spans")
    none = only(False).select("doc_id", "text", F.lit(None).cast("array<array<long>>").alias("spans"))
    return some.mapInArrow(digest, schema).union(none.mapInArrow(digest, schema))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages taken out of text (whole characters only), n_chars following it where there is one.

    Documents of which no word is left are dropped, others keep all their columns.
    """
    cut = spans(docs, length).withColumnsRenamed({"doc_id": "pairlake_of", "spans": "pairlake_spans"})

    @F.arrow_udf("string")
    def kept(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(text, gone):
            t, g = t.as_py(), g.as_py()
            if g is None or t is None:
                out.append(t)
                continue
            raw, at, parts = t.encode(), 0, []
            for s, e in g:
                while s < e and raw[s] & 0xC0 == 0x80:
                    s += 1
                while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e -= 1
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            out.append(b"".join(parts).decode())
        return pa.array(out, pa.string())

    kept = kept.asNondeterministic()  # else the filter below and the length cut each text once more

    columns = docs.columns
    sure, others = parted(docs, "doc_id", cut, "pairlake_of")
    out = others.join(cut, others["doc_id"].cast("long") == cut["pairlake_of"], "left")
    hit = F.col("pairlake_spans").isNotNull()
    out = out.withColumn("text", F.when(hit, kept("text", "pairlake_spans")).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return sure.union(out.where(~hit | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*columns))
