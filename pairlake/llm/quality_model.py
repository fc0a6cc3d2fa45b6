"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of about 400 bytes, all of them encoded: shares of pairs of byte classes
(Hellinger scaled), and how far words repeat. A hidden layer, gated attention and a logistic output
learn from document labels alone which passages matter; a text's score is that of its attention-
weighted passage representation. The fit takes a bounded sample of documents (SAMPLE of each label, by
hash) and all their passages, which go to a file and through each step in blocks of whole bags, so that
memory follows the longest bag; scoring covers every passage of every text.

Only text is an input of a score. Null or empty text is one passage without bytes and gets a score; a text of
any length goes through in slices of passages. An empty table gives no rows; other columns are kept or not read.
Labels that are null, neither 0 nor 1, or disagree for a doc_id aren't learnt from; without labels of
both kinds every score is the share of 1 (0.5 without any). Repeated rows are scored each. A null
doc_id isn't held out and keeps its row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written

PASSAGE = 400
SAMPLE = 1500
HIDDEN, GATE, STEPS, RATE, DECAY, SEED = 24, 12, 160, 0.02, 1e-4, 7
THRESHOLD = 0.7
#: Bytes that are encoded at once, passages of a longer text at once, and passages that a step of the fit takes at once.
BLOCK, SLICE, ROWS = 250_000, 500, 20_000

#: The classes of bytes; what isn't listed is control (14) or above ASCII (15).
CLASSES = {0: "abcdefghijklmnopqrstuvwxyz", 1: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: "0123456789", 3: " ", 4: "\n\t\r\v\f", 5: ".", 6: ",", 7: "!?", 8: "'\"`", 9: "#*$%&", 10: "|<>", 11: "()[]{}", 12: ":;-_/\\", 13: "@=+~^"}
KINDS = 16
CLASS = np.where(np.arange(256) < 128, 14, 15).astype(np.int64)
for _k, _chars in CLASSES.items():
    CLASS[[ord(c) for c in _chars]] = _k
SPACE = np.isin(CLASS, (3, 4))
MIXED = np.random.default_rng(11).integers(1, 1 << 62, 256).astype(np.uint64)
MIXED[SPACE] = 0
WIDTH = KINDS * KINDS + 5


def encode(texts: list[bytes], count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each passage, passages of each text); count: passages of each, where texts are slices of longer ones."""
    size = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-size // PASSAGE)) if count is None else count
    first = np.cumsum(count) - count
    total = int(count.sum())
    out = np.zeros((total, WIDTH), np.float32)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        return out, count
    of = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    passage = first[of] + at * count[of] // size[of]
    kind = CLASS[raw]
    same = passage[1:] == passage[:-1]
    pair = (passage[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
    counts = np.bincount(pair[same], minlength=total * KINDS * KINDS).reshape(total, -1)
    out[:, :-5] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    out[:, -5] = np.log1p(np.bincount(passage, minlength=total)) / 6
    space = SPACE[raw]
    start = np.flatnonzero(~space & np.r_[True, space[:-1] | ~same])  # a passage's end parts words too: passages stand alone
    if len(start):
        word, p = np.add.reduceat(MIXED[raw], start), passage[start]
        words = np.maximum(1, np.bincount(p, minlength=total))
        again = (word[1:] == word[:-1]) & (p[1:] == p[:-1])
        out[:, -4] = np.bincount(p[1:][again], minlength=total) / words
        order = np.lexsort((word, p))
        word, q = word[order], p[order]
        repeat = (word[1:] == word[:-1]) & (q[1:] == q[:-1])
        out[:, -3] = np.bincount(q[1:][repeat], minlength=total) / words
        out[:, -2] = np.bincount(passage[~space], minlength=total) / words / 10
        out[:, -1] = np.log1p(words) / 5
    return out, count


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over the passages of a bag."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [r.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), r.normal(0, GATE**-0.5, GATE), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.p = [x.astype(np.float32) for x in self.p]

    def forward(self, x: np.ndarray, count: np.ndarray):
        w, b, v, u, a, c, d = self.p
        first, bag = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v), _sig(h @ u)
        e = (t * g) @ a
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        share = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(share[:, None] * h, first)
        return _sig(z @ c + d), (x, h, t, g, share, z, first, bag)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, n: int) -> list[np.ndarray]:
        """What these of n bags add to the gradients of the mean loss."""
        score, (z0, h, t, g, share, z, first, bag) = self.forward(x, count)
        w, b, v, u, a, c, d = self.p
        ds = ((score - y) / n).astype(np.float32)
        dz = ds[:, None] * c
        dshare = (dz[bag] * h).sum(1)
        de = share * (dshare - np.add.reduceat(share * dshare, first)[bag])
        dtg = de[:, None] * a
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = share[:, None] * dz[bag] + dt @ v.T + dg @ u.T
        dp = dh * (1 - h * h)
        return [z0.T @ dp, dp.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ ds, ds.sum(keepdims=True)]

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> Attention:
        """x may be mapped from a file: a step adds up the gradients of blocks of whole bags."""
        one, two = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p]
        blocks = bags(count)
        ends = np.r_[0, np.cumsum(count)]
        for step in range(1, STEPS + 1):
            grads = [np.zeros_like(q) for q in self.p]
            for i, j in blocks:
                for k, more in zip(grads, self.gradients(x[ends[i] : ends[j]], count[i:j], y[i:j], len(y))):
                    k += more
            for i, (q, k) in enumerate(zip(self.p, grads)):
                k = k + DECAY * q
                one[i] = 0.9 * one[i] + 0.1 * k
                two[i] = 0.999 * two[i] + 0.001 * k * k
                self.p[i] = (q - RATE * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text. A text beyond BLOCK goes through in slices of whole passages, so memory doesn't follow its length."""
        if len(texts) != 1 or len(texts[0]) <= BLOCK:
            return self.forward(*encode(texts))[0]
        text, (w, b, v, u, a, c, d) = texts[0], self.p
        size, count = len(text), -(-len(text) // PASSAGE)
        most, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for k in range(0, count, SLICE):
            n = min(SLICE, count - k)
            own = [text[-(-i * size // count) : -(-(i + 1) * size // count)] for i in range(k, k + n)]
            rows = encode(own, np.ones(n, np.int64))[0]
            h = np.tanh(np.clip((rows - self.mean) / self.scale, -6, 6) @ w + b)
            e = (np.tanh(h @ v) * _sig(h @ u)) @ a
            now = max(most, float(e.max()))
            old, part = np.exp(most - now), np.exp(e - now)
            most, total, z = now, total * old + part.sum(), z * old + part @ h
        return _sig((z / total) @ c + d)


def bags(count: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of bags of ROWS passages at most, or of one bag."""
    out, at, rows = [], 0, 0
    for i, n in enumerate(count):
        if i > at and rows + n > ROWS:
            out.append((at, i))
            at, rows = i, 0
        rows += n
    return [*out, (at, len(count))]


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches (…, text as bytes last), cut so that a block's texts come to BLOCK bytes or are one text."""
    for batch in small(batches):
        column = batch[batch.num_columns - 1]
        size = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
        at = total = 0
        for i, n in enumerate([*size, BLOCK]):
            if i > at and (i == len(size) or total + n > BLOCK):
                yield batch.slice(at, i - at), [t or b"" for t in column.slice(at, i - at).to_pylist()]
                at, total = i, 0
            total += n


def fit(docs: DataFrame, labels: DataFrame) -> Attention | Constant:
    """The model of labels.quality, from documents that aren't held out; at most 2 * SAMPLE of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    known = known.groupBy("of").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").where(~held_out(F.col("of")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = known.join(texts.select(F.col("doc_id").alias("of")).distinct(), "of", "left_semi")
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("of"), "of").limit(SAMPLE) for y in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]).select("of", "y"))  # 2 * SAMPLE rows at most
    rows = texts.join(sample, F.col("doc_id") == F.col("of")).withColumn("digest", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    first = rows.groupBy(F.col("doc_id").alias("first_of")).agg(F.min("digest").alias("first"))  # of a doc_id's texts the one with the smallest digest
    rows = rows.join(first, (F.col("doc_id") == F.col("first_of")) & (F.col("digest") == F.col("first"))).dropDuplicates(["doc_id"]).select("doc_id", "y", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _blocks(batches):
            if len(texts) == 1:
                text = texts[0]
                size, n = len(text), max(1, -(-len(text) // PASSAGE))
                for k in range(0, n, SLICE):
                    own = [text[-(-i * size // n) : -(-(i + 1) * size // n)] for i in range(k, min(n, k + SLICE))]
                    x = encode(own, np.ones(len(own), np.int64))[0]
                    yield pa.RecordBatch.from_arrays([block[0], block[1], pa.array([k]), pa.array([x.tobytes()], pa.binary())], names=["doc_id", "y", "k", "x"])
                continue
            x, count = encode(texts)
            first = np.cumsum(count) - count
            yield pa.RecordBatch.from_arrays([block[0], block[1], pa.array(np.zeros(len(count), np.int64)), pa.array([x[f : f + n].tobytes() for f, n in zip(first, count)], pa.binary())], names=["doc_id", "y", "k", "x"])

    got = written(rows.mapInArrow(scan, "doc_id long, y int, k long, x binary"), "passages")
    sizes = got.groupBy("doc_id", "y").agg(F.sum(F.length("x")).alias("n"))
    known = sorted((r["doc_id"], r["y"], r["n"]) for r in sizes.collect())  # 2 * SAMPLE rows at most
    y = np.array([k[1] for k in known], np.float32)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    count = np.array([k[2] // (4 * WIDTH) for k in known])
    at = dict(zip((k[0] for k in known), np.cumsum(count) - count))
    with tempfile.TemporaryFile() as f:
        x = np.memmap(f, np.float32, "w+", shape=(int(count.sum()), WIDTH))
        for r in got.toLocalIterator():  # one file's documents at a time
            bag = np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH)
            x[at[r["doc_id"]] + r["k"] : at[r["doc_id"]] + r["k"] + len(bag)] = bag
        dropped(got)
        ends = np.r_[0, np.cumsum(count)]
        parts = [x[ends[i] : ends[j]] for i, j in bags(count)]
        mean = sum(p.sum(0, dtype=np.float64) for p in parts) / len(x)
        scale = np.sqrt(sum(((p - mean) ** 2).sum(0) for p in parts) / len(x)) + 0.01
        return Attention(mean.astype(np.float32), scale.astype(np.float32)).fit(x, count, y)


def score(docs: DataFrame, model: Attention | Constant) -> DataFrame:
    """doc_id, score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _blocks(batches):
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays([block[0], pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of threshold or more, all their columns kept."""
    model = fit(docs, labels)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("binary").alias("raw"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _blocks(batches):
            fine = pa.array(model.scores(texts) >= threshold)
            yield block.select([0]).filter(fine)

    return whole.mapInArrow(keep, whole.select("row").schema).select("row.*")
