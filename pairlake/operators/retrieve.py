"""Retrieval: cutoffs, as-of and interval joins, spreading, ranking, and cached verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .order import numbered


#: Parts of a key that first values are taken of at once.
PARTS = 64
#: Days of one range of an as-of join.
RANGE_DAYS = 32


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], value: Sequence[str], strict: bool, days: int = RANGE_DAYS) -> DataFrame:
    """left with right_<value> of the latest right row by ``by`` whose ``on`` (a date, a timestamp or a number) is before (or, unless strict, at) its own.

    One shuffle by the keys and ranges of ``days``, so neither a frequent key nor a join without keys
    meets in one task: both sides are stacked and sorted by range, the last right row is carried forward
    in it, and rows before a range's first right row get the last one of the ranges before, of which
    there is one for each key and range. Of several right rows at one time the greatest by value counts.
    """
    last = F.struct(*(F.col(v) for v in value))
    keys = [f"b_{b}" for b in by]
    own = [F.col(b).alias(k) for b, k in zip(by, keys)]
    number = isinstance(right.schema[on].dataType, NumericType)
    bucket = F.floor((F.col(on) if number else F.datediff(F.col(on), F.lit("1970-01-01").cast("date"))) / days).alias("bucket")
    stacked_left = left.select(*own, bucket, F.col(on).alias("t"), F.lit(0 if strict else 2).alias("turn"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.select(last).schema[0].dataType).alias("last"))
    row_type = stacked_left.schema["row"].dataType
    stacked_right = right.select(*own, bucket, F.col(on).alias("t"), F.lit(1).alias("turn"), F.lit(None).cast(row_type).alias("row"), last.alias("last"))
    both = stacked_left.union(stacked_right)
    w = Window.partitionBy(*keys, "bucket").orderBy("t", "turn", "last").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("found", F.last("last", ignorenulls=True).over(w)).where("row is not null")
    ends = both.select(*keys, "bucket", F.when(F.col("turn") == 1, F.struct("t", "last")).alias("end")).groupBy(*keys, "bucket").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col("bucket").alias("e_bucket"), F.last("end", ignorenulls=True).over(earlier)["last"].alias("earlier"))
    same = F.col("bucket").eqNullSafe(F.col("e_bucket"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    got = carried.join(ends, same).withColumn("found", F.coalesce("found", "earlier"))
    return got.select("row.*", *(F.col(f"found.{v}").alias(f"right_{v}") for v in value))


def interval_matches(events: DataFrame, articles: DataFrame, days: int) -> DataFrame:
    """Events (event_id, day) with the articles of the ``days`` days before, as an equi-join on days."""
    buckets = events.withColumn("at", F.explode(F.sequence(F.date_sub("day", days), F.date_sub("day", 1)))).withColumnRenamed("day", "event_day")
    return buckets.join(articles, buckets["at"] == articles["day"]).drop("at")


def first_of(rows: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """keys, first: the k smallest values of order by keys, in order.

    A bounded partial aggregate: each of many parts of a key keeps its own k, by window, and those are merged.
    """
    parts = F.pmod(F.xxhash64(order), F.lit(PARTS)).alias("part_")
    some = rows.select(*keys, order, parts)
    own = some.withColumn("r_", F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(order))).where(F.col("r_") <= k)
    return own.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("first"))  # k * PARTS at most


def normal_title(title: Column) -> Column:
    """Lower case without non-word characters."""
    return F.lower(F.regexp_replace(title, r"(?U)\W+", ""))


def headlines(articles: DataFrame, score: Column) -> DataFrame:
    """article_id, day, name (a digest of the normal title) and score: what matching needs of an article, without its text."""
    return articles.select("article_id", "day", F.md5(normal_title(F.col("title"))).alias("name"), score.alias("score"))


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    """Of each event's matches (with name and score) the first of each name (by article_id), then the k best by score, then latest."""
    best = Window.partitionBy("event_id").orderBy(F.col("score").desc(), F.col("day").desc(), "article_id")
    one = matches.groupBy("event_id", "name").agg(F.min(F.struct("article_id", "day", "score")).alias("m")).select("event_id", "m.*")
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def even_spread(rows: DataFrame, key: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """Of each key the rows at floor(i n / cap) for i < cap; all with n <= cap or no cap. Rows move: give it what is needed."""
    placed = numbered(rows, key, order, "pos", "spread_n")
    if cap <= 0:
        return placed.drop("spread_n")
    r, n = F.col("pos").cast("long"), F.col("spread_n")
    i = F.floor((r * cap + n - 1) / n).cast("long")  # the first i with i n / cap >= pos
    return placed.where((n <= cap) | ((i < cap) & (F.floor(i * n / cap) == r))).drop("spread_n")


def relevance(headline: Column, terms: Sequence[str]) -> Column:
    """How many terms are in the words of a headline, joined by spaces."""
    words = F.array_join(F.regexp_extract_all(F.lower(headline), F.lit("[a-z][a-z+]{2,}"), F.lit(0)), " ")
    return sum((F.contains(words, F.lit(t)).cast("int") for t in terms), F.lit(0))


def ranked(rows: DataFrame, key: Sequence[str], terms: Sequence[str], least: int) -> DataFrame:
    """rows without their titles, with score, rank (stable, best first) and kept; none is lost."""
    scored = rows.withColumn("score", relevance(F.col("title"), terms))
    placed = numbered(scored.drop("title"), key, [F.col("score").desc(), "article_id"], "at_", "n_")
    return placed.withColumns({"rank": (F.col("at_") + 1).cast("int"), "kept": F.col("score") >= least}).drop("at_", "n_")


def short_hash(parts: Column, n: int) -> Column:
    return F.substring(F.sha1(F.array_join(parts, "\n")), 1, n)


def verdict_key(topic: Column, titles: Column) -> Column:
    """The key of a cached answer about a topic and its titles (or a single text as an array of one)."""
    return F.substring(F.sha1(F.concat(topic, F.lit("||"), F.array_join(titles, "\n"))), 1, 16)


def semantic_ranked(cases: DataFrame, cache: DataFrame, topic: str) -> DataFrame:
    """cases (topic and titles) with the cached answer, kept (numbers of titles from 1), and fail_open.

    An answer has a number and a word for each title. All titles are kept where there is no answer or it keeps none, as
    leaving out noise must not lose a case; nothing is ever asked. cache: key, answer, a row for each key.
    """
    said = cases.withColumn("key", verdict_key(F.col(topic), F.col("titles"))).join(cache, "key", "left").drop("key")
    pattern, low = F.lit(r"(\d+)\s*[:.)]\s*(yes|no|relevant|irrelevant)"), F.lower(F.coalesce("answer", F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(low, pattern, F.lit(1)).alias("i"), F.regexp_extract_all(low, pattern, F.lit(2)).alias("said"))
    yes = F.transform(F.filter(pairs, lambda x: x["said"].isin("yes", "relevant")), lambda x: x["i"].try_cast("int"))
    every = F.sequence(F.lit(1), F.size("titles"))
    said = said.withColumn("kept", F.array_intersect(every, yes))
    return said.withColumn("fail_open", F.size("kept") == 0).withColumn("kept", F.when(F.col("fail_open"), every).otherwise(F.col("kept")))


def without_overwrite(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return have.unionByName(new.join(have, key, "left_anti"))


def first_names(rows: DataFrame, n: int) -> DataFrame:
    """The n distinct usable names (name) that come first (at): no short ones, namespaces, lists, and pages that aren't articles."""
    name = F.col("name")
    odd = F.contains(name, F.lit(":")) | F.startswith(name, F.lit("List_of")) | F.startswith(name, F.lit("Wikipedia")) | name.isin("Main_Page", "-")
    fine = rows.where((F.length(name) >= 4) & ~odd)
    return fine.groupBy("name").agg(F.min("at").alias("first")).orderBy("first", "name").limit(n).select("name")
