"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, whatever their order. Two words that
differ by one letter have keys that differ by one power (an addition or removal) or by the difference of
two (an exchange); no two such differences of letters below U+0100 are equal.

1. Counts. A scan counts each text's runs of letters, combined within a task before they are shuffled.
2. Keys. Each word gives its own key, and for each of its letters the key without it. Equal keys are
   then a removal (own against without) or an exchange (without against without). A word's half that the
   letter isn't in must be whole in both, so it goes into the join's key: anagrams with nothing
   else in common never meet, and each pair meets in one place only.
3. Order of letters. Pairs that share a key are verified within the join, so only near words leave it.
4. Forms are followed to their end by pointer doubling; counts at least double with each step, so a
   chain has as many words at most as the largest count has bits.

Words and their places are never broadcast: a table of words is small on disk, its places are ten times as many rows,
and Spark takes their size from the table.

Null text has no words, and neither has a text without letters. A row with a null doc_id has its words counted unchanged. Repeated
rows count each time. Very long texts go through in slices that end between words. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written

#: Maximal runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
RUN, END = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
POWER, CHARS, TIMES, RATIO, EVERY = 5, 5, 3, 2, 97
#: Characters of a text that are looked at at once; words that a task holds before it sends their counts.
SLICE, HELD = 1 << 21, 200_000


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters, slice by slice."""
    at = 0
    while at < len(text):
        end = END.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = end.start() if end else len(text)
        yield RUN.findall(text, at, end)
        at = end


def misspelt(run: str, start: int, every: int) -> str:
    """The run, without one letter if ``every`` divides the checksum that goes on from start."""
    h = zlib.crc32(run.encode(), start)
    return run if h % every else run[: (at := h % len(run))] + run[at + 1 :]


def word_counts(docs: DataFrame, chars: int = CHARS, times: int = TIMES, every: int | None = None) -> DataFrame:
    """word, n: words of so many characters and occurrences at least.

    every: of the runs of each document, about one in ``every`` loses a letter first, by the checksum of doc_id and run.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in small(batches):
            for doc, text in zip(batch[0], batch[1]):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc.as_py()}:".encode()) if every and doc.is_valid else None
                for found in runs(text.as_py().lower().decode()):  # of bytes, so only A-Z change
                    if start is None:
                        held.update(w for w in found if len(w) >= chars)
                    else:
                        for run, n in Counter(found).items():
                            word = misspelt(run, start, every)
                            if len(word) >= chars:
                                held[word] += n
                    if len(held) >= HELD:
                        yield sent()
        if held:
            yield sent()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def powers(word: str) -> int:
    """The word's key: the sum of its letters' powers."""
    return sum(ord(c) ** POWER for c in word)


def signed(x: int) -> int:
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def places(word: str) -> Iterator[tuple[int, int, int, bool]]:
    """(key, spot, letter left out or 0, whether the spot is the last half) under which a word meets near ones.

    The spot hashes the half that stays whole and the longer word's length.
    """
    key, n = powers(word), len(word)
    for longer in (n, n + 1):
        half = longer // 2
        for last in (False, True):
            whole = word[n - (longer - half) :] if last else word[:half]
            spot = signed(xxhash.xxh3_64_intdigest(whole.encode(), seed=2 * longer + last))
            if longer > n:
                yield signed(key), spot, 0, last
            else:
                for c in set(word[:half] if last else word[half:]):
                    yield signed(key - ord(c) ** POWER), spot, ord(c), last


PLACES = "key long, spot long, letter int, last boolean, word string, n long"


def _placed(words: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 5_000):
            rows = [(*p, i) for i, w in enumerate(batch[0].to_pylist()) for p in places(w)]
            key, spot, letter, last, of = zip(*rows)
            of = pa.array(of, pa.int32())
            arrays = [pa.array(key, pa.int64()), pa.array(spot, pa.int64()), pa.array(letter, pa.int32()), pa.array(last, pa.bool_()), batch[0].take(of), batch[1].take(of)]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PLACES.split(", ")])

    return words.select("word", "n").mapInArrow(spread, PLACES)


def near(words: DataFrame) -> DataFrame:
    """word, n, other, m: pairs that differ by one inserted, deleted or replaced code point, both ways round."""
    x = _placed(words)
    y = x.toDF("key", "spot", "y_letter", "y_last", "other", "m")
    half = F.greatest(F.char_length("word"), F.char_length("other")).cast("int")
    half = F.shiftright(half, 1)
    once = ~F.col("last") | (F.col("word").substr(F.lit(1), half) != F.col("other").substr(F.lit(1), half))
    meet = x.hint("merge").join(y, ["key", "spot"]).where((F.col("letter") != F.col("y_letter")) & (F.col("last") == F.col("y_last")) & (F.col("word") != F.col("other")))
    return meet.where(once & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "m")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: a written table."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.hint("merge").join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(now)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new


def variants(docs: DataFrame, chars: int = CHARS, times: int = TIMES, ratio: int = RATIO, every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its most frequent near word, if ``ratio`` times as frequent."""
    words = written(word_counts(docs, chars, times, every), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    found = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.hint("merge").join(found, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    far = -F.col("best.m") >= ratio * F.col("n")
    found = found.select("word", "n", "n_near", F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form is not null"))
    return found.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
