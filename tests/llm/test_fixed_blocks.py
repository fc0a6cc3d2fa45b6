"""Removal of repeated passages of words against brute force, on given and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from pairlake.llm import fixed_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    least = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                least[key] = min(d, least.get(key, d))
    out = collections.Counter()
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and least[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def got(df, length):
    found = fixed_blocks.removed(df, length, texts=True).collect()
    for r in found:
        assert sum(e - s for s, e in r.spans) == r.n_removed and all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:]))
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(texts(df), 13)
    assert got(df, 13) == want and sum(k[2] > 0 for k in want) > 5


@pytest.mark.parametrize("length", (13, 6))
def test_awkward_rows(spark, monkeypatch, length):
    """Shared passages at all offsets, one of them in most documents; periodic texts, long words, repeated ids."""
    monkeypatch.setattr(fixed_blocks, "SLICE", 300)
    monkeypatch.setattr(fixed_blocks, "KNOWN", 20)
    monkeypatch.setattr(fixed_blocks, "ROWS", 7)
    r = random.Random(length)
    some = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    hot, long = some(40), some(400)
    passages = [hot] * 6 + [some(r.randrange(5, 30)) for _ in range(12)] + [["x"] * 40, ["a", "b"] * 25, ["é" * 500, "ü"] * 12]
    rows = []
    for i in range(120):
        words = some(r.randrange(0, 20))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            s = r.randrange(0, 8)
            words += p[s : s + r.randrange(4, 60)] + some(r.randrange(0, 9))
        rows.append((r.randrange(0, 100), r.choice([" ", "\n", "\t \r"]).join(words)))
    rows += [(200, " ".join(long)), (201, " ".join(long[3:390])), (202, "  " + " ".join(long[100:200] + some(3) + long[203:])), (203, " ".join(long)), (204, " ".join(long[:12])), (205, " ".join(long[:13])), (206, " ".join(long[:12]))]
    rows += [(210, " ".join(hot)), (210, " ".join(long)), (210, " ".join(hot)), (None, " ".join(hot)), (None, None), (211, None), (212, ""), (213, " \n "), (214, " ".join(hot)), (215, "é" * 100_000), (-5, " ".join(hot[3:]))]
    df = spark.createDataFrame([(*x, 7, 7, 7, 7) for x in rows], "doc_id long, text string, row int, n int, of int, found int").repartition(3)
    assert got(df, length) == brute(rows, length)
    assert got(df.limit(0), length) == {}


def test_many_contexts_of_one_block(spark):
    """A short passage in all documents, each time between other words: contents grow with documents, pairs don't."""
    r = random.Random(2)
    hot = [f"h{i}" for i in range(9)]
    rows = [(i, " ".join([f"a{r.randrange(5)}" for _ in range(6)] + hot + [f"b{r.randrange(5)}" for _ in range(6)])) for i in range(400)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 13) == brute(rows, 13)


def test_every_window_holds_a_block():
    for length in range(3, 121):
        block = fixed_blocks.block_of(length)
        assert all(any(s <= p and p + block <= s + length for p in range(0, 400, block)) for s in range(120))


def test_filter_keeps_all():
    filter = fixed_blocks.Filter(50_000)
    x = np.random.default_rng(1).integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2)
    words = np.zeros(((1 << filter.bits), (1 << filter.inner) // 8), np.uint8)
    bucket, once, _ = filter.dealer.deal([x[:50_000]])
    for b, o in zip(bucket.to_pylist(), once.to_pylist()):
        words[b] = np.frombuffer(filter.packed(np.frombuffer(o, np.uint32)), np.uint8)
    has = filter.has(words.ravel(), x)
    assert has[:50_000].all() and has[50_000:].mean() < 0.05


def test_filter_holds_marked_blocks_only(spark, monkeypatch):
    """Many times more blocks than the filter has bits: only those that two documents have take room in it."""
    monkeypatch.setattr(fixed_blocks, "BITS", 12)
    monkeypatch.setattr(fixed_blocks, "MOST_BITS", 12)
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    shared = some(40)
    rows = [(i, " ".join(some(300) + shared[: 40 * (i % 100 == 0)] + some(300))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = spark.sparkContext.broadcast(fixed_blocks.ids(df, "doc_id"))
    marks = fixed_blocks._marked(df, 13, kept, fixed_blocks.Filter(25_000))
    assert 0 < np.unpackbits(marks).mean() < 0.1
    assert got(df, 13) == brute(rows, 13)


def test_hashes_of_many_texts_at_once():
    """Texts together, long ones and long words in stretches: the same hashes at the same places, none across texts."""
    r = random.Random(6)
    texts = [b"", b" ", b"a", *(b"\n ".join(r.choice([b"a", b"b" * 70, b"c\xc3\xa9", b"d" * 64]) for _ in range(n)) for n in (5, 12, 13, 14, 40, 400)), b" x " * 60_000]
    seen = {}
    for of, at, x, _ in fixed_blocks.windows(texts, 13):
        assert len(of) == len(at) == len(x)
        seen |= dict(zip(zip(of.tolist(), at.tolist()), x.tolist()))
    want = {(i, at + k): v for i, t in enumerate(texts) for at, _, x in fixed_blocks.stretches(t, 13) for k, v in enumerate(x.tolist())}
    assert seen == want and {i for i, _ in seen} == {i for i, t in enumerate(texts) if len(t.split()) >= 13}
