"""Mined url rules where tokens go together, where labels are few, and with columns that clash."""

import itertools
import random

from pyspark.sql import functions as F

from pairlake.llm import url_filter


def brute(rows, least, confidence):
    """(tokens, verdict) -> confidence of all rules that no subset is as confident as."""
    tokens = sorted({x for t, _ in rows for x in t})
    found = {}
    for k in range(1, len(tokens) + 1):
        for items in itertools.combinations(tokens, k):
            of = [y for t, y in rows if set(items) <= set(t)]
            for label, verdict in ((0, "block"), (1, "allow")):
                n = sum(y == label for y in of)
                if n >= least:
                    found[items, verdict] = n / len(of)
    rules = {k: c for k, c in found.items() if c >= confidence}
    return {(i, v): c for (i, v), c in rules.items() if not any(v == w and set(j) < set(i) and d >= c for (j, w), d in found.items())}


def test_tokens_that_go_together(spark):
    """Like all rules by enumeration, any token of an item standing for it; a subset below the least confidence passes its own subsets' on."""
    local = random.Random(3)
    rows = []
    for _ in range(300):
        t = {x for x in "abc" if local.random() < 0.5} | ({"d", "e"} if local.random() < 0.5 else set()) | {"u", "v", "w"}
        rows.append((sorted(t), int(local.random() < (0.95 if "a" in t else 0.3 if "d" in t else 0.5))))
    want = brute(rows, 5, 0.6)
    got = url_filter.mined(spark.createDataFrame(rows, "tokens array<string>, label int"), 0.005, 0.6).collect()
    spread = {}
    for r in got:
        for items in itertools.product(*r.tokens):
            spread[tuple(sorted(items)), r.verdict] = r.confidence
    assert {k: round(c, 9) for k, c in spread.items()} == {k: round(c, 9) for k, c in want.items()}
    assert any(["d", "e"] in r.tokens for r in got) and any(r.tokens == [["u", "v", "w"]] for r in got)


def test_many_tokens_on_every_url_and_few_labels(spark):
    """Twelve tokens on every url, fewer than 200 labels: they are one item, and the rules are few."""
    path = "/".join(f"part{i}" for i in range(12))
    rows = [(i, f"https://{'bad' if i % 3 == 0 else 'good'}{i % 4}.example.net/{path}/{i}") for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(7) for c in ("tokens", "item", "rule", "label", "token", "host", "verdict")})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(150)}
    tokens = pages.select("page_id", url_filter.tokens(F.col("url"), *url_filter.parts(F.col("url"))).alias("t"))
    rules = url_filter.mined(tokens.join(labels, F.col("page_id") == F.col("doc_id")).select(F.col("t").alias("tokens"), F.col("quality").alias("label")))
    assert rules.count() < 40


def test_fewer_labels_than_the_floor(spark):
    rows = [(["a"], 0)] * 4
    assert url_filter.mined(spark.createDataFrame(rows, "tokens array<string>, label int")).count() == 0
