"""Probes over cached predictions, reports of them, and what feeds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..functions import series as S
from ..operators import brier as B
from ..operators import evaluate as E
from ..operators import probe as M
from ..operators import retrieve as R
from ..plans import views as V
from . import evaluation as Z
from . import lexical as Q
from . import pairing, retrieval
from .building import oil_emit, wiki_emit
from .common import Registry, r6

query = Registry()
ERRORS = f"""{Z.TREND}, v_arm AS (SELECT series_id, dataset, origin, {Z.LV} / CASE WHEN step = 0 THEN 1e-6 ELSE step END AS a, {Z.LT} / CASE WHEN step = 0 THEN 1e-6 ELSE step END AS b,
  list_avg(list_transform(future, lambda v: abs(v - my))) / CASE WHEN step = 0 THEN 1e-6 ELSE step END AS c, list_avg(list_transform(future, lambda v: abs(v - history[9]))) / CASE WHEN step = 0 THEN 1e-6 ELSE step END AS ba FROM m)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of four forecasts of each item that stand for cached ones: last value, trend, mean, the value before the last."""
    h, f = F.col("history"), F.col("future")
    flat = lambda c: F.array_repeat(c, 5)
    forecasts = {"a": S.last_value(h, 5), "b": S.linear_trend(h, 5), "c": flat(S.mean(h)), "ba": flat(F.get(h, F.lit(8)))}
    return Z.items(spark, sf_dir).select("series_id", "dataset", "origin", *(S.mase(x, f, h).alias(k) for k, x in forecasts.items()))


@query(f"{ERRORS}, x AS (SELECT count(*) AS n, median(a) AS a, median(b) AS b, median(c) AS c, median(ba) AS ba, count(*) FILTER (WHERE b < a) AS b_over_a, count(*) FILTER (WHERE b < c) AS b_over_c, count(*) FILTER (WHERE a = b AND b = c) AS degenerate FROM v_arm) SELECT n, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(ba, 6) AS ba, b_over_a, b_over_c, round(CASE WHEN a <> b THEN (a - ba) / (a - b) * 100 ELSE 0 END, 3)::DOUBLE AS retained, degenerate > 0.15 * n AS unreliable FROM x")
def four_arm_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.probe(arms(spark, sf_dir))
    return p.select("n", *(r6(x).alias(x) for x in ("a", "b", "c", "ba")), "b_over_a", "b_over_c", F.round("retained", 3).alias("retained"), "unreliable")


@query(f"{ERRORS}, x AS (SELECT dataset, a, CASE WHEN day(origin) % 7 = 0 THEN a ELSE b END AS b, c, day(origin) % 7 = 0 AS fallback FROM v_arm) SELECT dataset, count(*) AS n, round(median(a), 6) AS a, round(median(b), 6) AS b, round(median(c), 6) AS c, count(*) FILTER (WHERE fallback) AS fallbacks FROM x GROUP BY 1")
def chattime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the arms by dataset; where the model gave nothing, the last value stands in and is counted."""
    x = arms(spark, sf_dir).withColumn("fallback", F.dayofmonth("origin") % 7 == 0)
    x = x.withColumn("b", F.when(F.col("fallback"), F.col("a")).otherwise(F.col("b")))
    return x.groupBy("dataset").agg(F.count("*").alias("n"), *(r6(F.median(k)).alias(k) for k in ("a", "b", "c")), F.count_if("fallback").alias("fallbacks"))


@query(f"{Z.ERR}, s AS (SELECT domain, day, avg(err_a) AS a, avg(err_b) AS b, avg(err_c) AS c, count(*) AS seeds FROM v_err GROUP BY ALL) SELECT domain, count(*) AS n, round(median(a), 6) AS a, round(median(b), 6) AS b, round(median(c), 6) AS c, count(*) FILTER (WHERE b < a AND b < c) AS wins, max(seeds) AS seeds FROM s GROUP BY 1")
def finetune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are averaged first, then arms compared by domain."""
    s = Z.errors(spark, sf_dir).groupBy("domain", "day").agg(*(F.avg(f"err_{k}").alias(k) for k in "abc"), F.count("*").alias("seeds"))
    return s.groupBy("domain").agg(F.count("*").alias("n"), *(r6(F.median(k)).alias(k) for k in "abc"), F.count_if((F.col("b") < F.col("a")) & (F.col("b") < F.col("c"))).alias("wins"), F.max("seeds").alias("seeds"))


@query(f"{Z.ARMS} SELECT series_id, md5('') AS a_md5, md5(text) AS b_md5, md5(other) AS c_md5 FROM s")
def export_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three arms of an item in one row."""
    x = Z.armed(spark, sf_dir)
    of = lambda arm: F.md5(F.max(F.when(F.col("arm") == arm, F.col("arm_text"))))
    return x.groupBy("series_id").agg(of("A_no_text").alias("a_md5"), of("B_flywheel_text").alias("b_md5"), of("C_shuffled_text").alias("c_md5"))


FAITH = f"{Q.FAITHFUL}, v_score AS (SELECT article_id AS id, domain, ({retrieval._relevance('title')})::INT AS score FROM v_article)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.article(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("title").alias("txt"), R.relevance(F.col("title"), retrieval.TERMS).alias("score"))
    faith = Q._faithful(a.select("id", "txt")).withColumnRenamed("id", "of")
    return a.select("id", "score").join(faith, F.col("id") == F.col("of"))


@query(f"{FAITH} SELECT t AS least, count(*) FILTER (WHERE score < t) AS dropped, count(*) FILTER (WHERE score >= t AND verdict = 'ok') AS faithful FROM v_score JOIN v_faith USING (id) CROSS JOIN (VALUES (1), (2), (3)) x(t) GROUP BY 1")
def faithful_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each least score: what is dropped, and what is kept and still grounded."""
    each = scored(spark, sf_dir).withColumn("least", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    kept = F.col("score") >= F.col("least")
    return each.groupBy("least").agg(F.count_if(~kept).alias("dropped"), F.count_if(kept & (F.col("verdict") == "ok")).alias("faithful"))


@query(f"{FAITH} SELECT count(*) AS n, count(*) FILTER (WHERE score < 2) AS dropped, count(*) FILTER (WHERE score >= 2 AND verdict = 'ok') AS faithful, true AS noise_dropped, true AS signal_kept FROM v_score JOIN v_faith USING (id)")
def semantic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What denoising drops and leaves grounded; one headline of noise has to go and one of signal to stay."""
    s = scored(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("score") < 2).alias("dropped"), F.count_if((F.col("score") >= 2) & (F.col("verdict") == "ok")).alias("faithful"))
    of = lambda t: R.relevance(F.lit(t), retrieval.TERMS)
    return s.withColumn("noise_dropped", of("Naira forex reserves") < 2).withColumn("signal_kept", of("The nation and OPEC are out of spare capacity") >= 2)


KEY = "substr(sha1(text || '|[' || array_to_string(list_transform(history, lambda v: round(v, 3)::VARCHAR), ', ') || ']|5'), 1, 16)"


@query(f"""{Z.ITEM}, c AS (SELECT series_id, history, {KEY} AS key, CASE day(origin) % 3 WHEN 1 THEN '1.5, 2.5 and 3' WHEN 2 THEN '9, 8, 7, 6, 5, 4' END AS answer FROM v_g),
p AS (SELECT *, list_transform(regexp_extract_all(coalesce(answer, ''), '-?\\d+\\.?\\d*'), lambda x: x::DOUBLE)[1:5] AS n FROM c) SELECT series_id, key, len(n) AS parsed, round((coalesce(list_sum(n), 0) + (5 - len(n)) * history[10]) * 0.137931, 3) AS total FROM p""")
def llmtime_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers by key and item: numbers parsed, cut to the horizon, and filled up with the last value.

    Items of one key (equal texts and histories) keep their own answers.
    """
    i = Z.items(spark, sf_dir).withColumn("key", M.cache_key(F.col("text"), F.col("history"), 5))
    day = F.dayofmonth("origin") % 3
    cache = i.where(day > 0).select(F.col("key").alias("cached"), F.col("series_id").alias("of"), F.when(day == 1, "1.5, 2.5 and 3").otherwise("9, 8, 7, 6, 5, 4").alias("answer"))
    j = i.join(cache, (F.col("key") == F.col("cached")) & (F.col("series_id") == F.col("of")), "left")
    j = j.withColumn("n", M.parsed(F.col("answer"), 5))
    return j.select("series_id", "key", F.size("n").cast("long").alias("parsed"), F.round(S.total(M.filled(F.col("n"), F.col("history"), 5)) * 0.137931, 3).alias("total"))


@query("WITH f AS (SELECT DISTINCT o_custkey AS id, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F' AND day(o_orderdate) BETWEEN 5 AND 25) SELECT id, count(*) AS years, max(y)::INT AS last_year FROM f GROUP BY 1")
def edgar_year_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pairing.scan_xbrl_annual(spark, sf_dir)
    return a.groupBy("id").agg(F.countDistinct("fy").alias("years"), F.max("fy").alias("last_year"))


@query("WITH g AS (SELECT o_custkey AS id, o_orderpriority AS tag, count(DISTINCT year(o_orderdate)) AS n, max(year(o_orderdate)) AS y FROM orders GROUP BY ALL HAVING count(DISTINCT year(o_orderdate)) >= 4) SELECT id, tag, n FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, y DESC, tag) = 1")
def edgar_repull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags chosen again, of four years at least."""
    return pairing.xbrl_best_tag(spark, sf_dir).where("n >= 4").select("id", "tag", "n")


@query(f"{pairing.QUAKE}, n AS (SELECT o_custkey AS id, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT id, round(list_max(s) - list_min(s), 2) AS spike_pt, (last >= TIMESTAMP '2000-01-01')::INT AS recency, round(sqrt(greatest(list_avg(list_transform(s, lambda x: x * x)) - pow(list_avg(s), 2), 0)), 1) AS series_std, len(string_split(c_name || ' ' || c_mktsegment, ' ')) AS text_words FROM q JOIN n USING (id) JOIN customer ON id = c_custkey")
def cyber_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pairing._quakes(spark, sf_dir)
    last = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("last"))
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    j = q.join(last, F.col("id") == F.col("key")).join(c, F.col("id") == F.col("c_custkey"))
    f = M.features(F.col("s"), F.col("last") >= F.lit("2000-01-01").cast("timestamp"), F.col("text"))
    return j.select("id", F.round(f["spike_pt"], 2).alias("spike_pt"), f["recency"].alias("recency"), F.round(f["series_std"], 1).alias("series_std"), f["text_words"].cast("long").alias("text_words"))


@query(f"WITH {V.PRICE}, w AS (SELECT series_id, idx, sum(price) OVER h AS h, count(*) OVER h AS nh, sum(price) OVER f AS f, count(*) OVER f AS nf FROM v_price WINDOW h AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) SELECT series_id, idx, round(h * 0.137931, 3) AS history, round(f * 0.137931, 3) AS future FROM w WHERE nh = 25 AND nf = 5")
def adapt_fnspid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 sessions through the day, and the next five."""
    w = Window.partitionBy("series_id").orderBy("idx")
    x = V.price(spark, sf_dir).withColumns({"h": F.collect_list("price").over(w.rowsBetween(-24, 0)), "f": F.collect_list("price").over(w.rowsBetween(1, 5))})
    x = x.where((F.size("h") == 25) & (F.size("f") == 5))
    return x.select("series_id", "idx", F.round(S.total(F.col("h")) * 0.137931, 3).alias("history"), F.round(S.total(F.col("f")) * 0.137931, 3).alias("future"))


@query(f"WITH a AS ({wiki_emit.sql}), b AS ({oil_emit.sql}) SELECT 'wiki' AS adapter, series_id, count(*) AS n FROM a WHERE reason = 'emitted' GROUP BY ALL UNION ALL SELECT 'oil', series_id, count(*) FROM b WHERE reason = 'emitted' GROUP BY ALL")
def adapt_flywheel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the emission ladders let out, replayed by adapter."""
    out = [f(spark, sf_dir).where("reason = 'emitted'").groupBy("series_id").agg(F.count("*").alias("n")).withColumn("adapter", F.lit(k)) for k, f in (("wiki", wiki_emit), ("oil", oil_emit))]
    return out[0].unionByName(out[1]).select("adapter", "series_id", "n")


@query(f"WITH {V.PROB} SELECT horizon, count(*) AS n, count(*) FILTER (WHERE id % 4 <> 0) AS forecast, round(avg(pow(p_up - resolved_to, 2)) FILTER (WHERE id % 4 <> 0), 6) AS brier FROM v_prob GROUP BY 1")
def brier_skipnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over points that have a forecast."""
    p = V.prob(spark, sf_dir).withColumn("p_up", F.when(F.col("id") % 4 != 0, F.col("p_up")))
    return p.groupBy("horizon").agg(F.count("*").alias("n"), F.count("p_up").alias("forecast"), r6(F.avg(B.brier("p_up"))).alias("brier"))


@query(f"WITH {V.PROB} SELECT id, CASE WHEN domain = 'fred' THEN 'fred' ELSE 'yfinance' END AS label FROM v_prob")
def domain_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prob(spark, sf_dir).select("id", B.domain_label(F.col("domain")).alias("label"))


@query(f"WITH {V.PRICE} SELECT series_id, idx, printf('%.6g', price * 0.137931) AS shown, printf('%.6g', price * 0.137931 / 1e9) AS small FROM v_price")
def fmt_6g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six significant digits without trailing zeros."""
    return V.price(spark, sf_dir).select("series_id", "idx", S.general(F.col("price") * 0.137931).alias("shown"), S.general(F.col("price") * 0.137931 / 1e9).alias("small"))


QUERIES, ORACLES = query.queries, query.oracles
