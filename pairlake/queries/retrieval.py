"""Retrieval over documents as dated articles and salient days as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import retrieve as R
from ..plans import views as V
from ..sources.files import scratch
from .common import Registry, r6

query = Registry()

TERMS = ("the", "ther", "and", "tion")
EVENTS = f"{V.PRICE}, {V.ARTICLE}, v_event AS (SELECT series_id || '_' || idx AS event_id, series_id, idx, dt AS day FROM v_price)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.price(spark, sf_dir).select(F.concat_ws("_", "series_id", F.col("idx").cast("string")).alias("event_id"), "series_id", "idx", F.col("dt").alias("day"))


@query(f"WITH {EVENTS} SELECT event_id, day::TIMESTAMP AS strict_t, day::TIMESTAMP + INTERVAL 86399 SECOND AS same_day_t, (day - 4)::DATE AS lookback FROM v_event")
def cutoff_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("day").cast("timestamp")
    return events(spark, sf_dir).select("event_id", t.alias("strict_t"), (t + F.expr("INTERVAL 86399 SECOND")).alias("same_day_t"), F.date_sub("day", 4).alias("lookback"))


@query(f"WITH {EVENTS} SELECT event_id, count(*) FILTER (WHERE a.day < e.day) AS kept, count(*) FILTER (WHERE a.day >= e.day) AS dropped FROM v_event e JOIN v_article a ON a.day BETWEEN e.day - 4 AND e.day + 2 GROUP BY 1")
def apply_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles are counted by day before events meet them."""
    e = events(spark, sf_dir).withColumn("at", F.explode(F.sequence(F.date_sub("day", 4), F.date_add("day", 2)))).withColumnRenamed("day", "event_day")
    a = V.article(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    j = e.join(a, e["at"] == a["day"])
    n = lambda fine: F.coalesce(F.sum(F.when(fine, F.col("n"))), F.lit(0)).cast("long")
    return j.groupBy("event_id").agg(n(F.col("day") < F.col("event_day")).alias("kept"), n(F.col("day") >= F.col("event_day")).alias("dropped"))


MATCH = f"""{EVENTS}, v_head AS (SELECT article_id, day, md5(lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g'))) AS nt, len(title) - len(replace(title, 'th', '')) AS score FROM v_article), m AS (
  SELECT e.event_id, a.* FROM v_event e JOIN v_head a ON a.day >= e.day - 4 AND a.day < e.day),
one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id, nt ORDER BY article_id) = 1)"""


@query(f"WITH {MATCH} SELECT event_id, article_id, day, score, (row_number() OVER (PARTITION BY event_id ORDER BY score DESC, day DESC, article_id))::INT AS rank FROM one QUALIFY rank <= 8")
def range_join_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.length("title") - F.length(F.replace("title", F.lit("th"), F.lit("")))).cast("long")
    m = R.interval_matches(events(spark, sf_dir), R.headlines(V.article(spark, sf_dir), score), 4)
    return R.top_matches(m, 8).select("event_id", "article_id", "day", "score", "rank")


@query(f"WITH {MATCH} SELECT event_id, article_id FROM one QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY article_id) <= 8")
def gdelt_dedupe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.interval_matches(events(spark, sf_dir), R.headlines(V.article(spark, sf_dir), F.lit(0)), 4).withColumn("day", F.lit("2000-01-01").cast("date"))
    return R.top_matches(m, 8).select("event_id", "article_id")


@query(f"WITH {V.ARTICLE} SELECT article_id, route FROM v_article JOIN (VALUES ('gas', '(?:ti|an)on'), ('gold', '^The'), ('oil', 'de la')) r(route, pat) ON regexp_matches(title, pat)")
def route_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = {"gas": "(?:ti|an)on", "gold": "^The", "oil": "de la"}
    hit = F.array_compact(F.array(*(F.when(F.col("title").rlike(p), k) for k, p in routes.items())))
    return V.article(spark, sf_dir).select("article_id", F.explode(hit).alias("route"))


SPREAD = f"""WITH {V.ARTICLE}, one AS (SELECT *, date_trunc('month', day)::DATE AS month FROM v_article QUALIFY row_number() OVER (PARTITION BY month, lower(title) ORDER BY article_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY day, article_id) - 1 AS pos, count(*) OVER (PARTITION BY month) AS n FROM one)"""


@query(f"{SPREAD} SELECT month, article_id, pos::INT AS pos FROM r WHERE n <= 3 OR pos IN (SELECT i * r.n // 3 FROM range(3) t(i))")
def even_spread_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.article(spark, sf_dir).select("article_id", "day", F.trunc("day", "month").alias("month"), F.md5(F.lower("title")).alias("name"))
    one = a.groupBy("month", "name").agg(F.min(F.struct("article_id", "day")).alias("m")).select("month", "m.*")
    return R.even_spread(one, ["month"], ["day", "article_id"], 3).select("month", "article_id", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {V.ARTICLE}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY article_id) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n FROM v_article) SELECT domain, article_id FROM r WHERE n <= 7 OR pos IN (SELECT i * r.n // 7 FROM range(7) t(i))")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.even_spread(V.article(spark, sf_dir).select("domain", "article_id"), ["domain"], ["article_id"], 7).select("domain", "article_id")


REPORT = f"{EVENTS}, v_rep AS (SELECT day, max(article_id) AS article_id FROM v_article GROUP BY day)"


def _asof(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    reports = V.article(spark, sf_dir).groupBy("day").agg(F.max("article_id").alias("article_id"))
    out = R.asof_backward(events(spark, sf_dir), reports, "day", [], ["day", "article_id"], strict)
    return out.select("event_id", F.col("right_day").alias("report_day"), F.col("right_article_id").alias("article_id"))


@query(f"WITH {REPORT} SELECT event_id, r.day AS report_day, r.article_id FROM v_event e ASOF LEFT JOIN v_rep r ON e.day >= r.day")
def asof_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, False)


@query(f"WITH {REPORT} SELECT event_id, r.day AS report_day, coalesce(r.article_id, -1) AS article_id, CASE WHEN r.day IS NULL THEN 'no_prior_revision' END AS reason FROM v_event e ASOF LEFT JOIN v_rep r ON e.day > r.day")
def asof_revision_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, True).withColumn("article_id", F.coalesce("article_id", F.lit(-1).cast("long"))).withColumn("reason", F.when(F.col("report_day").isNull(), "no_prior_revision"))


@query(f"""WITH {EVENTS}, v_dom AS (SELECT domain, day, max(article_id) AS article_id FROM v_article GROUP BY ALL), e AS (SELECT event_id, day, 'src' || (idx % 20) AS domain FROM v_event)
SELECT event_id, coalesce(d.article_id, -1) AS article_id FROM e ASOF LEFT JOIN v_dom d ON e.domain = d.domain AND e.day > d.day""")
def asof_revision_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("domain", F.concat(F.lit("src"), (F.col("idx") % 20).cast("string")))
    d = V.article(spark, sf_dir).groupBy("domain", "day").agg(F.max("article_id").alias("article_id"))
    return R.asof_backward(e, d, "day", ["domain"], ["article_id"], True).select("event_id", F.coalesce("right_article_id", F.lit(-1).cast("long")).alias("article_id"))


@query(f"""WITH {EVENTS}, v_dom AS (SELECT domain, day, max(article_id) AS article_id FROM v_article GROUP BY ALL), e AS (SELECT event_id, day, 'src' || (idx % 20) AS domain FROM v_event)
SELECT event_id, d.day AS report_day, coalesce(d.article_id, -1) AS article_id FROM e ASOF LEFT JOIN v_dom d ON e.domain = d.domain AND e.day > d.day""")
def asof_revision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of lookup as a stream: events and articles in files without any order, then the end."""
    from ..streaming import asof

    e = events(spark, sf_dir).select(F.concat(F.lit("src"), (F.col("idx") % 20).cast("string")).alias("key"), F.col("day").cast("timestamp").alias("t"), F.lit(1).alias("kind"), F.xxhash64("event_id").alias("id"), "event_id")
    a = V.article(spark, sf_dir).select(F.col("domain").alias("key"), F.col("day").cast("timestamp").alias("t"), F.lit(0).alias("kind"), F.col("article_id").alias("id"))
    source, out, at = (scratch(spark, x) for x in ("stream", "answers", "progress"))
    e.drop("event_id").unionByName(a).repartition(4, F.xxhash64("id")).write.parquet(source)
    asof.over_files(spark, source, out, at, "20000 days", 2)
    asof.end(spark, source)
    asof.over_files(spark, source, out, at, "20000 days", 2)
    got = spark.read.schema(asof.FOUND).parquet(out)
    day = F.timestamp_millis("report_at").cast("date")
    return e.select("event_id", "id").join(got, "id").select("event_id", day.alias("report_day"), F.coalesce("report_id", F.lit(-1).cast("long")).alias("article_id"))


def _relevance(c: str) -> str:
    words = f"array_to_string(regexp_extract_all(lower({c}), '[a-z][a-z+]{{2,}}'), ' ')"
    return " + ".join(f"contains({words}, '{t}')::INT" for t in TERMS)


@query(f"WITH {V.ARTICLE} SELECT article_id, ({_relevance('title')})::INT AS score FROM v_article")
def relevance_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.article(spark, sf_dir).select("article_id", R.relevance(F.col("title"), TERMS).cast("int").alias("score"))


RANKED = f"WITH {V.ARTICLE}, s AS (SELECT domain, article_id, title, ({_relevance('title')})::INT AS score FROM v_article), r AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY score DESC, article_id))::INT AS rank, score >= 3 AS kept FROM s)"


@query(f"{RANKED} SELECT domain, article_id, score, rank, kept FROM r")
def rank_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(V.article(spark, sf_dir), ["domain"], TERMS, 3).select("domain", "article_id", F.col("score").cast("int").alias("score"), "rank", "kept")


@query(f"{RANKED} SELECT domain, t AS least, count(*) FILTER (WHERE score >= t) AS kept, count(*) FILTER (WHERE score < t) AS noise, bool_and(coalesce(prev >= score, true)) AS ordered FROM (SELECT *, lag(score) OVER (PARTITION BY domain ORDER BY rank) AS prev FROM r) CROSS JOIN (VALUES (1), (2), (3)) x(t) GROUP BY ALL")
def retrieval_tradeoff_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and lost by threshold, and whether ranks follow scores: ranges of ranks of a score don't overlap those of a better one."""
    r = R.ranked(V.article(spark, sf_dir), ["domain"], TERMS, 3)
    by = r.groupBy("domain", "score").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))  # a row for each score: few
    better = F.max("hi").over(Window.partitionBy("domain").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    by = by.withColumn("fine", F.coalesce(better < F.col("lo"), F.lit(True)))
    each = by.withColumn("least", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    n = lambda good: F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0))
    return each.groupBy("domain", "least").agg(n(F.col("score") >= F.col("least")).alias("kept"), n(F.col("score") < F.col("least")).alias("noise"), F.bool_and("fine").alias("ordered"))


@query(f"WITH {V.ARTICLE}, h AS (SELECT domain, list(title ORDER BY article_id)[1:6] AS h FROM v_article GROUP BY 1) SELECT domain, substr(sha1(array_to_string(h, chr(10))), 1, 12) AS key FROM h")
def headlines_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = R.first_of(V.article(spark, sf_dir), ["domain"], "article_id", 6).select("domain", F.posexplode("first").alias("r", "of"))
    texts = V.article(spark, sf_dir).select("article_id", "title")
    a = first.join(texts, F.col("of") == F.col("article_id"))  # six titles of each domain
    h = a.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("h"))
    return h.select("domain", R.short_hash(F.col("h"), 12).alias("key"))


#: Six titles of each domain and year, and a cache of answers about them: labelled articles are judged by their labels.
CASES = f"""WITH {V.ARTICLE}, v_case AS (SELECT coalesce(domain, '') AS domain, year(day)::INT AS year, list(article_id ORDER BY article_id)[1:6] AS ids, list(title ORDER BY article_id)[1:6] AS titles FROM v_article GROUP BY ALL),
v_line AS (SELECT domain, year, i, max(quality) AS quality FROM (SELECT domain, year, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM v_case) JOIN labels ON doc_id = id WHERE quality IS NOT NULL GROUP BY ALL),
v_answer AS (SELECT domain, year, string_agg(i || CASE WHEN quality <> 1 THEN ') Irrelevant' WHEN i % 2 = 0 THEN ': yes' ELSE '. Relevant' END, chr(10) ORDER BY i) AS answer FROM v_line GROUP BY ALL),
v_keyed AS (SELECT *, substr(sha1(domain || '||' || array_to_string(titles, chr(10))), 1, 16) AS key FROM v_case),
v_cache AS (SELECT key, min(answer) AS answer FROM v_keyed JOIN v_answer USING (domain, year) GROUP BY 1),
v_said AS (SELECT k.*, answer, list_filter(range(1, len(titles) + 1), lambda i: regexp_matches(lower(coalesce(answer, '')), '(^|[^0-9])' || i || '\\s*[:.)]\\s*(yes|relevant)')) AS yes FROM v_keyed k LEFT JOIN v_cache USING (key)),
v_kept AS (SELECT domain, year, titles, answer, len(yes) = 0 AS fail_open, CASE WHEN len(yes) = 0 THEN range(1, len(titles) + 1) ELSE yes END AS kept FROM v_said)"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(domain, year, titles), and the cache (key, answer)."""
    a = V.article(spark, sf_dir).select("article_id", F.coalesce("domain", F.lit("")).alias("domain"), F.year("day").alias("year"))
    first = R.first_of(a, ["domain", "year"], "article_id", 6).select("domain", "year", F.posexplode("first").alias("i", "id"))
    titles = V.article(spark, sf_dir).select(F.col("article_id").alias("id"), "title")
    said = V.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    n = F.col("i") + 1
    line = F.concat(n.cast("string"), F.when(F.col("quality") != 1, ") Irrelevant").when(n % 2 == 0, ": yes").otherwise(". Relevant"))
    rows = first.join(titles, "id").join(said, "id", "left").withColumn("line", F.when(F.col("quality").isNotNull(), line))
    each = F.array_sort(F.collect_list(F.struct("i", "title", "line")))  # six at most
    cases = rows.groupBy("domain", "year").agg(each.alias("e")).select("domain", "year", F.col("e.title").alias("titles"), F.array_compact("e.line").alias("lines"))
    cache = cases.where(F.size("lines") > 0).groupBy(R.verdict_key(F.col("domain"), F.col("titles")).alias("key")).agg(F.min(F.array_join("lines", "\n")).alias("answer"))
    return cases.select("domain", "year", "titles"), cache


@query(f"{CASES} SELECT domain, year, len(titles)::INT AS n, answer IS NULL AS unknown, fail_open, array_to_string(kept, ',') AS kept FROM v_kept")
def semantic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that cached answers call relevant; all of them where there is no answer or none is."""
    got = R.semantic_ranked(*_cases(spark, sf_dir), "domain")
    return got.select("domain", "year", F.size("titles").alias("n"), F.col("answer").isNull().alias("unknown"), "fail_open", F.array_join("kept", ",").alias("kept"))


@query(f"{CASES} SELECT domain, year, CASE WHEN len(titles) <= 2 OR answer IS NULL THEN 'raw' ELSE 'cache' END AS used, md5(array_to_string(CASE WHEN len(titles) <= 2 THEN titles ELSE list_transform(kept, lambda i: titles[i]) END, chr(10))) AS titles_md5 FROM v_kept")
def rank_titles_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two titles or fewer pass; of more those that the cache keeps."""
    got = R.semantic_ranked(*_cases(spark, sf_dir), "domain")
    few = F.size("titles") <= 2
    titles = F.when(few, F.col("titles")).otherwise(F.transform("kept", lambda i: F.get("titles", i - 1)))
    return got.select("domain", "year", F.when(few | F.col("answer").isNull(), "raw").otherwise("cache").alias("used"), F.md5(F.array_join(titles, "\n")).alias("titles_md5"))


@query(f"WITH {MATCH} SELECT event_id, strftime(max(day)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS knowledge_time FROM one GROUP BY 1")
def knowledge_time_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.interval_matches(events(spark, sf_dir), V.article(spark, sf_dir).select("day").distinct(), 4)
    return m.groupBy("event_id").agg(F.date_format(F.max("day").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("knowledge_time"))


@query(f"WITH {EVENTS} SELECT DISTINCT strftime(d, '%Y-%m') AS month FROM (SELECT day AS d FROM v_event UNION ALL SELECT (day - 4)::DATE FROM v_event)")
def months_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.explode(F.array("day", F.date_sub("day", 4))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month")).distinct()


@query(f"WITH {EVENTS}, have AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM v_article WHERE domain = 'src1') SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM v_event WHERE strftime(day, '%Y-%m') NOT IN (SELECT month FROM have)")
def pool_monthly_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = V.article(spark, sf_dir).where("domain = 'src1'").select(F.date_format("day", "yyyy-MM").alias("month")).distinct()
    return events(spark, sf_dir).select(F.date_format("day", "yyyy-MM").alias("month")).distinct().join(have, "month", "left_anti")


@query("SELECT o_custkey AS key, max(o_totalprice) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def merge_events_no_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("v"))
    return R.without_overwrite(have, V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v")), "key")


@query(f"WITH {V.ARTICLE} SELECT domain AS source, strftime(day, '%Y-%m') AS month, min(title) AS title, count(*) AS n FROM v_article WHERE day >= DATE '1996-01-01' AND day < DATE '2001-01-01' AND regexp_matches(title, 'tion') GROUP BY ALL")
def pool_bigquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the pool's dates and pattern: by source and month the first title and how many."""
    a = V.article(spark, sf_dir).where((F.col("day") >= "1996-01-01") & (F.col("day") < "2001-01-01") & F.col("title").rlike("tion"))
    return a.groupBy(F.col("domain").alias("source"), F.date_format("day", "yyyy-MM").alias("month")).agg(F.min("title").alias("title"), F.count("*").alias("n"))


@query("SELECT event_type, month, lo, hi, n FROM (SELECT event_type, date_trunc('month', ts)::DATE AS month, strftime(date_trunc('month', ts), '%Y%m%d') AS lo, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y%m%d') AS hi, count(*) AS n FROM events GROUP BY ALL)")
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.trunc("ts", "month")
    return V.table(spark, sf_dir, "events").groupBy("event_type", m.alias("month")).agg(F.count("*").alias("n")).select("event_type", "month", F.date_format("month", "yyyyMMdd").alias("lo"), F.date_format(F.add_months("month", 1), "yyyyMMdd").alias("hi"), "n")


QUERIES, ORACLES = query.queries, query.oracles
