"""Probabilistic-forecast scoring: Brier scores by forecaster, domain, horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brier as B
from ..plans import views as V
from .common import Registry, r6

query = Registry()
P = f"WITH {V.PROB}"
BUCKET = "CASE WHEN horizon <= 7 THEN '<=7' WHEN horizon <= 30 THEN '<=30' WHEN horizon <= 90 THEN '<=90' ELSE '>90' END"


@query("SELECT l_orderkey AS id, round(avg(l_discount), 6) AS crowd FROM lineitem GROUP BY 1")
def crowd_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").cast("string").try_cast("double").alias("f"))
    return t.groupBy(F.col("l_orderkey").alias("id")).agg(r6(F.avg("f")).alias("crowd"))


@query("""WITH q AS (SELECT o_orderkey AS id, [o_totalprice * 0.7, o_totalprice * 0.9, o_totalprice, o_totalprice * 1.2]::DOUBLE[] AS q, 150000.0::DOUBLE AS last FROM orders)
SELECT id, round(CASE WHEN last <= q[1] THEN 0.9 WHEN last >= q[4] THEN 0.1
  WHEN last <= q[2] THEN 1 - (0.1 + 0.2 * (last - q[1]) / (q[2] - q[1])) WHEN last <= q[3] THEN 1 - (0.3 + 0.2 * (last - q[2]) / (q[3] - q[2]))
  ELSE 1 - (0.5 + 0.4 * (last - q[3]) / (q[4] - q[3])) END, 6)::DOUBLE AS p_up FROM q""")
def p_up_from_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    q = F.array(*(F.col("o_totalprice") * f for f in (0.7, 0.9, 1.0, 1.2)))
    return o.select(F.col("o_orderkey").alias("id"), r6(B.p_up(q, (0.1, 0.3, 0.5, 0.9), F.lit(150000.0))).alias("p_up"))


@query("""SELECT o_orderkey AS id, (SELECT count(*) FROM generate_series(o_orderdate::DATE, (o_orderdate::DATE + (o_orderkey % 40)::INT - 1)::DATE, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)::INT AS days FROM orders WHERE o_orderkey % 40 > 0""")
def busday_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.to_date("o_orderdate")
    o = V.table(spark, sf_dir, "orders").where("o_orderkey % 40 > 0")
    return o.select(F.col("o_orderkey").alias("id"), B.business_days(a, F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))).alias("days"))


@query(f"{P} SELECT domain, round(avg(pow(p_up - resolved_to, 2)), 6) AS brier FROM v_prob GROUP BY 1")
def brier_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prob(spark, sf_dir).groupBy("domain").agg(r6(F.avg(B.brier("p_up"))).alias("brier"))


LEAD = f"{P}, {V.MODEL}, s AS (SELECT model, domain, pow(forecast - resolved_to, 2) AS b FROM v_model JOIN v_prob USING (id) WHERE model NOT IN ('m1', 'm2'))"


@query(f"{LEAD}, g AS (SELECT model, count(*) AS n, avg(b) AS b, avg(b) FILTER (WHERE domain = 'fred') AS f, avg(b) FILTER (WHERE domain = 'yahoo') AS y FROM s GROUP BY 1 HAVING count(*) >= 20) SELECT model, n, round(b, 6) AS brier, round(f, 6) AS fred, round(y, 6) AS yahoo, (row_number() OVER (ORDER BY b, model))::INT AS rank FROM g")
def brier_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.model(spark, sf_dir).where(~F.col("model").isin("m1", "m2")).join(V.prob(spark, sf_dir), "id")
    return B.leaderboard(s, least=20).select("model", "n", r6("b").alias("brier"), r6("f").alias("fred"), r6("y").alias("yahoo"), "rank")


@query(f"{P} SELECT {BUCKET} AS bucket, count(*) AS n FROM v_prob GROUP BY 1")
def horizon_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prob(spark, sf_dir).groupBy(B.bucket(F.col("horizon")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{P}, c AS (SELECT (id % 4)::INT AS ctx, {BUCKET} AS bucket, pow(p_up - resolved_to, 2) AS b FROM v_prob) SELECT ctx, coalesce(bucket, 'ALL') AS bucket, round(avg(b), 6) AS brier FROM c GROUP BY GROUPING SETS ((ctx, bucket), (ctx))")
def brier_ctx_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.prob(spark, sf_dir).select((F.col("id") % 4).cast("int").alias("ctx"), B.bucket(F.col("horizon")).alias("bucket"), B.brier("p_up").alias("b"))
    return c.groupingSets([["ctx", "bucket"], ["ctx"]], "ctx", "bucket").agg(r6(F.avg("b")).alias("brier")).withColumn("bucket", F.coalesce("bucket", F.lit("ALL")))


@query(f"{P}, {V.MODEL}, m AS (SELECT model, {BUCKET} AS bucket, avg(pow(forecast - resolved_to, 2)) AS b FROM v_model JOIN v_prob USING (id) GROUP BY ALL) SELECT bucket, round(median(b), 6) AS brier FROM m GROUP BY 1")
def llm_median_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.model(spark, sf_dir).join(V.prob(spark, sf_dir), "id").groupBy("model", B.bucket(F.col("horizon")).alias("bucket")).agg(F.avg(B.brier("forecast")).alias("b"))
    return m.groupBy("bucket").agg(r6(F.median("b")).alias("brier"))


@query(f"{P} SELECT horizon, coalesce(domain, 'ALL') AS domain, round(median(pow(p_up - resolved_to, 2)), 6) AS brier FROM v_prob GROUP BY GROUPING SETS ((horizon, domain), (horizon))")
def domain_horizon_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.prob(spark, sf_dir).withColumn("b", B.brier("p_up"))
    return p.groupingSets([["horizon", "domain"], ["horizon"]], "horizon", "domain").agg(r6(F.median("b")).alias("brier")).withColumn("domain", F.coalesce("domain", F.lit("ALL")))


@query(f"{P} SELECT id, round(pow(p_up - resolved_to, 2), 6) AS brier FROM v_prob ORDER BY pow(p_up - resolved_to, 2) DESC, id LIMIT 10")
def worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prob(spark, sf_dir).select("id", B.brier("p_up").alias("b")).orderBy(F.desc("b"), "id").limit(10).select("id", r6("b").alias("brier"))


@query(f"{P} SELECT domain, count(*) AS n, round(max(pow(human - resolved_to, 2)), 6) AS worst_human FROM v_prob WHERE pow(p_up - resolved_to, 2) > 0.4 AND pow(human - resolved_to, 2) > 0.4 GROUP BY 1")
def both_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.prob(spark, sf_dir).where((B.brier("p_up") > 0.4) & (B.brier("human") > 0.4))
    return p.groupBy("domain").agg(F.count("*").alias("n"), r6(F.max(B.brier("human"))).alias("worst_human"))


@query(f"{P} SELECT p.id, p.horizon, c.o_orderpriority AS crowd FROM v_prob p JOIN orders c ON p.id = c.o_orderkey WHERE c.o_orderstatus <> 'O'")
def fetch_bench_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("crowd"))
    return V.prob(spark, sf_dir).join(o, "id").select("id", "horizon", "crowd")


QUERIES, ORACLES = query.queries, query.oracles
