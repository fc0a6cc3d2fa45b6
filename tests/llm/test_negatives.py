"""Hard negatives against brute force, on awkward rows and with one label on most rows."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from pairlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, size int, g int"


def brute(rows, n, k, low, high):
    """Counter of (anchor, positive, rank, negative, both scores, positive's rank)."""
    fine = [(i, tuple(math.floor(256 * x) for x in v), str(y)) for i, v, y, *_ in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for a in {r[0] for r in fine if r[0] % 10 == 0}:
        _, v, label = min((r for r in fine if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, y) for i, w, y in fine if i != a and len(w) == len(v))
        for at, (p, i, _) in enumerate([s for s in scored if s[2] == label][:n], 1):
            found = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:k]
            out.update((a, i, rank, j, -p, -s, at) for rank, (s, j, _) in enumerate(found, 1))
    return out


def got(df, **more):
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more)
    return collections.Counter(map(tuple, found.collect()))


def rows_of(seed, many, share):
    r = random.Random(seed)
    return [(i, [r.choice([r.gauss(0.3, 1), 0.5]) for _ in range(8)], 1 if r.random() < share else r.randrange(4), 7, 7, 7) for i in range(many)]


@pytest.mark.parametrize("share", (0.0, 0.9))
def test_like_brute_force(spark, monkeypatch, share):
    """Small blocks and groups, also with a label on nine rows of ten: many units, none of them large."""
    monkeypatch.setattr(negatives, "BLOCK", 400)
    monkeypatch.setattr(negatives, "GROUP", 64)
    monkeypatch.setattr(negatives, "SCORES", 200)
    rows = rows_of(3, 260, share)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == brute(rows, 5, 10, 30, 90)
    assert got(df, n=2, k=3, low=50, high=70) == brute(rows, 2, 3, 50, 70)
    units, _ = negatives._blocks(df.select("vec_id", F.col("embedding").alias("v"), F.lit(8).alias("size")), df.where("vec_id % 10 = 0").select("vec_id", F.lit(8).alias("size")), "size")
    sizes = [r["count"] for r in units.count().collect()]
    assert len(sizes) > 6 and max(sizes) * 8 <= 4 * 400


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(5, 60, 0.3)
    rows += [(100, None, 1, 7, 7, 7), (110, [1.0] * 8, None, 7, 7, 7), (None, [1.0] * 8, 1, 7, 7, 7), (120, [nan] + [1.0] * 7, 1, 7, 7, 7), (121, [inf] * 8, 1, 7, 7, 7), (122, [None] * 8, 1, 7, 7, 7)]
    rows += [(130, [1.0, 2.0], 1, 7, 7, 7), (131, [1.0, 1.5], 1, 7, 7, 7), (132, [0.5, 0.25], 2, 7, 7, 7), (140, [], 1, 7, 7, 7), (141, [], 1, 7, 7, 7), (142, [], 2, 7, 7, 7)]
    rows += [rows[0], rows[11], rows[12], (20, [0.5] * 8, 0, 7, 7, 7), (31, [2.5] * 8, 3, 7, 7, 7), (31, [2.5] * 8, 3, 7, 7, 7), (32, [2.5] * 8, 3, 7, 7, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows, 5, 10, 30, 90)
    assert got(df.limit(0)) == {}


def test_all_equal(spark):
    """Equal vectors: ties go to smaller ids, and no score is below a positive's upper limit."""
    rows = [(i, [0.5, 1.0], i % 2, 7, 7, 7) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == {} and got(df, high=100) == brute(rows, 5, 10, 30, 100)
