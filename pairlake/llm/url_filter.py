"""URL filters: hand-written host and path rules, and association rules mined by FP-growth.

DataFrame functions and Spark's own FP-growth only. A url is host and path as the rules need them, and
a set of tokens (words of its host, path segments, names of its query, its scheme). Labelled pages become transactions of their tokens and their label. FP-growth mines token
combinations of any length. Tokens that the same labelled pages have are one item, so a token on every page or a
phrase of twelve tokens doesn't multiply combinations. Rules that conclude a label are pruned by support and confidence,
and a rule is dropped if one of its subsets is as confident, level by level. Pages meet rules by an inverted
index: each page's items join the items of rules, and a rule matches if all of them are met. The most
confident matching rule decides; without one, or on a tie, a page is allowed.

Rules written by hand come before mined ones: a rule fits its host and all subdomains if the path
starts with the rule's path; the longest fits best. Their list is a parameter, held in the plan.

A null url, or one without "://", has an empty host and path and no tokens: no rule fits and it is
allowed. Distinct urls are judged once, so copies of a url cost one. Labels that are null or that
disagree aren't mined, repeated labels count once for each page. Rows with a null page_id stay. Without labels nothing is mined.
A very long url is judged whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Share of labelled pages that a combination needs with its label, the least number of them, and the share of its pages that have the label.
SUPPORT, FLOOR, CONFIDENCE = 0.005, 5, 0.6
BLOCK_ITEM, ALLOW_ITEM = "label=block", "label=allow"
#: Entries of the rules' inverted index that may go to every task; a larger one is joined by token.
BROADCAST = 100_000

#: (host, path, verdict) of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up to "?" or "#"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url."""
    named = lambda mark, items: F.transform(items, lambda x: F.concat(F.lit(mark), x))
    segments = F.split(F.lower(path), "[/._-]+")
    query = F.transform(F.split(F.lower(F.regexp_extract(url, "(?s)\\?([^#]*)", 1)), "[&;]"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.lower(F.regexp_extract(url, "(?s)^([^:]*)://", 1)))
    pieces = F.split(host, "[.-]")
    found = F.concat(named("h:", pieces), named("p:", segments), named("q:", query), named("s:", scheme))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda x: F.char_length(x) > 2)))


def _folded(each: DataFrame, least: int) -> DataFrame:
    """(token, item): tokens of ``least`` rows or more; those of equal rows are one item, named after its smallest token."""
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)"))
    signed = each.groupBy("token").agg(F.count("*").alias("n"), of(1).alias("a"), of(2).alias("b")).where(F.col("n") >= least)
    items = signed.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return written(signed.join(items, ["n", "a", "b"]).select("token", "item"), "items")


def _unbeaten(sets: DataFrame, confidence: float) -> DataFrame:
    """The rules (items, size, verdict, confidence) that no subset of their items is as confident as.

    sets has all subsets of its item sets. Level by level each set takes the best confidence below it from
    the sets of one item less, by a hash of their items and by those: as many rows as a set has items.
    """
    most = sets.agg(F.max("size").alias("n")).first()["n"] or 0
    spread = written(sets.withColumns({"of": F.xxhash64("items", "verdict"), "below": F.lit(-1.0)}).where("size = 1"), "level")
    out = [spread]
    for size in range(2, most + 1):
        own = sets.where(F.col("size") == size)
        less = F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x))))
        less = own.select("items", "verdict", "confidence", less.alias("less")).withColumn("of", F.xxhash64("less", "verdict"))
        lower = out[-1].select("of", F.col("items").alias("less"), F.greatest("confidence", "below").alias("best"))
        best = less.join(lower, ["of", "less"]).groupBy("items", "verdict", "confidence").agg(F.max("best").alias("below"))
        out.append(written(best.select("items", "verdict", "confidence", F.lit(size).alias("size"), F.xxhash64("items", "verdict").alias("of"), "below"), "level"))
    names = ["items", "size", "verdict", "confidence"]
    fine = [df.where((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("below"))).select(*names) for df in out]
    return reduce(DataFrame.union, fine)


def mined(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, floor: int = FLOOR) -> DataFrame:
    """(rule, items, size, verdict, confidence, tokens) from rows (tokens, label 0 = block, 1 = allow).

    tokens: of each item all that stand for it. floor: labelled pages of a label that a combination needs, whatever the support.
    """
    rows = written(urls.where("label is not null").select(F.monotonically_increasing_id().alias("row"), "tokens", "label"), "labelled")
    n = rows.count()
    schema = "rule long, items array<string>, size int, verdict string, confidence double, tokens array<array<string>>"
    least = max(1, floor, int(-(-n * support // 1)))
    if n < least:
        return rows.sparkSession.createDataFrame([], schema)
    each = rows.select("row", F.explode("tokens").alias("token"))
    folded = _folded(each, least)  # rarer tokens can't be in a rule
    kept = each.join(folded, "token").groupBy("row").agg(F.collect_set("item").alias("kept"))  # a url's own items
    item = F.when(F.col("label") == 0, BLOCK_ITEM).otherwise(ALLOW_ITEM)
    none = F.array().cast("array<string>")
    rows = written(rows.join(kept, "row", "left").select(F.concat(F.coalesce("kept", none), F.array(item)).alias("items")), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n)).fit(rows)
    labels = F.array(F.lit(BLOCK_ITEM), F.lit(ALLOW_ITEM))
    own = F.array_intersect("items", labels)
    sets = model.freqItemsets.select(F.array_sort(F.array_except("items", labels)).alias("items"), F.get(own, F.lit(0)).alias("label"), F.size(own).alias("k"), "freq")
    sets = written(sets.where((F.size("items") > 0) & (F.col("k") < 2)).withColumn("of", F.xxhash64("items")), "sets")
    bare = sets.where("k = 0").select("of", "items", F.col("freq").alias("whole"))
    sets = sets.where("k = 1").join(bare, ["of", "items"]).select("items", F.size("items").alias("size"), F.when(F.col("label") == BLOCK_ITEM, "block").otherwise("allow").alias("verdict"), (F.col("freq") / F.col("whole")).alias("confidence"))
    rules = _unbeaten(written(sets, "sets"), confidence).withColumn("rule", F.xxhash64("items", "verdict"))
    named = folded.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("of"))  # frequent tokens
    tokens = rules.select("rule", F.posexplode("items").alias("at", "item")).join(named, "item").groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "of"))), lambda x: x["of"]).alias("tokens"))
    return written(rules.join(tokens, "rule").select("rule", "items", "size", "verdict", "confidence", "tokens"), "rules")


def _bounded(index: DataFrame) -> DataFrame:
    """An index of rules, to every task where it is small, else to be met by a merge join."""
    index = written(index, "index")
    return F.broadcast(index) if index.count() <= BROADCAST else index.hint("merge")


def _best(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, best): the highest confidence of the rules whose items a url (url, item: a row each) all has."""
    index = _bounded(rules.select("rule", F.explode("items").alias("item"), "size", "confidence"))
    met = urls.join(index, "item").groupBy("url", "rule", "size", "confidence").count().where(F.col("count") == F.col("size"))
    return met.groupBy("url").agg(F.max("confidence").alias("best"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls to block: a block rule matches, and no allow rule that is as confident.

    A url (url, tokens) has an item if it has any of its tokens: each of them alone was as good where the rules come from.
    Allow rules only matter where a block rule matches, so only those urls meet them.
    """
    named = rules.select(F.explode(F.arrays_zip("items", "tokens")).alias("x")).select(F.col("x.items").alias("item"), F.explode("x.tokens").alias("token")).distinct()
    found = urls.select("url", F.explode("tokens").alias("token")).join(_bounded(named), "token").groupBy("url", "item").count().select("url", "item")
    found = written(found, "items")
    block = written(_best(found, rules.where("verdict = 'block'")), "blocked")
    some = found.join(block.select("url").hint("merge"), "url", "left_semi")
    allow = _best(some, rules.where("verdict = 'allow'")).withColumnRenamed("best", "allow")
    out = block.join(allow.hint("merge"), "url", "left").where(F.coalesce("allow", F.lit(0.0)) < F.col("best"))
    return out.select("url", F.lit("block").alias("mined"))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest hand-written rule that fits, else nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in ranked]
    rule = F.coalesce(*(F.when(f, h + p) for f, (h, p, _) in zip(fits, ranked)), F.lit(None).cast("string"))
    return rule, F.coalesce(*(F.when(f, v) for f, (_, _, v) in zip(fits, ranked)), F.lit(None).cast("string"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES), support: float = SUPPORT, confidence: float = CONFIDENCE, floor: int = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict, url and mined (the method's own verdict) for every page.

    labels: rows (doc_id, quality) on pages of that number; quality 0 is to block.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    urls = page.select("url").where("url is not null").distinct().withColumns({"host": host, "path": path})
    urls = written(urls.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))), "urls")
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    known = known.groupBy("of").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("of", F.col("y").alias("label"))
    # tables that grow with the pages are never broadcast, however small they look when compressed
    own = page.join(known.hint("merge"), F.col("page_id") == F.col("of")).select("url", "label")
    labelled = own.join(urls.hint("merge"), "url").select("tokens", "label")
    found = matched(urls, mined(labelled, support, confidence, floor))
    rule, own = fitting(F.col("host"), F.col("path"), rules)
    out = page.withColumns({"host": host, "path": path}).join(found.hint("merge"), "url", "left")
    out = out.withColumns({"rule": rule, "own": own, "mined": F.coalesce("mined", F.lit("allow"))})
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "mined").alias("verdict"), "url", "mined")
