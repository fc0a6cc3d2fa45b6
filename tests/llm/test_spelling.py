"""Spelling variants against brute force, the keys' differences, awkward rows, one anagram class of very many words."""

import collections
import itertools
import random
import re
import zlib

import pytest

from pairlake.llm import spelling


def counted(rows, chars, times, every):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if every and doc is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= chars and k >= times}


def neighbours(words):
    """Words at one edit, by the strings with one letter masked or left out."""
    at = collections.defaultdict(set)
    for w in words:
        at[w].add(w)
        for i in range(len(w)):
            at[w[:i] + w[i + 1 :]].add(w)
            at[w[:i] + "\0" + w[i + 1 :]].add(w)
    out = {w: set() for w in words}
    for masked, found in at.items():
        for a in found:
            for b in found - {a}:
                if "\0" in masked or masked in (a, b):
                    out[a].add(b)
    return out


def brute(rows, chars=5, times=3, ratio=2, every=97):
    n = counted(rows, chars, times, every)
    close = neighbours(n)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return out


def got(df, **more):
    rows = list(map(tuple, spelling.variants(df, **more).collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


def test_like_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(df, every=97) == want and sum(w[1] is not None for w in want) > 10
    assert got(df, chars=1, times=1, every=7) == brute(rows, 1, 1, 2, 7)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 40)
    monkeypatch.setattr(spelling, "HELD", 5)
    r = random.Random(1)
    base = ["aaaaa", "aaaa", "aaaaaa", "ábcdé", "ÀBCDÉ", "abcde", "abcdef", "bacde", "abxde", "straße", "strasse", "x×÷yz", "a" * 300, "a" * 299 + "b", "abcabc", "abcabd"]
    rows = [(i, " ".join(r.choice(base) * r.choice([1, 1, 2]) + r.choice(["", "1", "_", "\n"]) for _ in range(40)), 7, 7, 7) for i in range(30)]
    rows += [(None, "abcde " * 50, 7, 7, 7), (31, None, 7, 7, 7), (32, "", 7, 7, 7), (33, "12 34 Ā 中", 7, 7, 7), rows[0], (None, None, 7, 7, 7), (34, "z" * 5000 + " q" * 5000, 7, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int, n int, key int").repartition(3)
    for every in (None, 2, 97):
        assert got(df, every=every) == brute([x[:2] for x in rows], every=every)
    assert got(df, chars=1, times=1) == brute([x[:2] for x in rows], 1, 1, every=None)
    assert got(df.limit(0)) == set()


def test_chain(spark):
    """Forms of forms: roots at the end of chains of any length."""
    words = [("abcdefghijklmnop"[: 6 + i], 3 * 2**i) for i in range(9)]
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(words)]
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute(rows, every=None) and {x[2] for x in found} == {words[-1][0]}


def test_differences_are_unique():
    """No exchange of letters has another one's value, nor that of an addition."""
    letters = [c for c in map(chr, range(256)) if spelling.RUN.fullmatch(c)]
    values = [spelling.powers(a) - spelling.powers(b) for a, b in itertools.permutations(letters, 2)] + [s * spelling.powers(a) for a in letters for s in (1, -1)]
    assert len(values) == len(set(values))


@pytest.mark.parametrize("n", (5, 6))
def test_one_anagram_class(spark, n):
    """All orders of the same letters: a key of one letter less is shared by all, but few words meet."""
    words = ["".join(p) for p in itertools.permutations("abcdef"[:n])] + ["bbcdef"[:n]]
    rows = [(0, " ".join(words * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows, every=None)
    meet = collections.Counter((k, s) for w in words for k, s, *_ in spelling.places(w))
    assert sum(c * c for c in meet.values()) < 60 * len(words) * n < sum(c * c for c in collections.Counter(k for w in words for k, *_ in spelling.places(w)).values())


def test_nothing_is_broadcast(spark):
    """A small table of words has many places: joins of them are merges, whatever size Spark expects."""
    df = spark.createDataFrame([(0, "abcdef abcdeg " * 5 + "abcdef " * 20)], "doc_id long, text string")
    words = spelling.written(spelling.word_counts(df), "words")
    for plan in (spelling.near(words), spelling.variants(df)):
        assert "Broadcast" not in plan._jdf.queryExecution().toString()
