"""Governance, build split, release catalogue, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..operators import governance as G
from ..operators.order import tree_digest, tree_sql
from ..plans import views as V
from .common import Registry

query = Registry()
GOV = f"""WITH {V.REGISTRY}, g AS (SELECT d.doc_id, d.source AS dataset, d.text, coalesce(a.source, d.source) AS source_id, coalesce(r.status, 'review_required') AS status,
  coalesce(r.license, 'NOASSERTION') AS license, r.terms_url, r.attribution FROM documents d LEFT JOIN v_alias a ON d.source = a.alias LEFT JOIN v_reg r ON coalesce(a.source, d.source) = r.source),
e AS (SELECT *, concat_ws(',', CASE WHEN status NOT IN ('approved', 'conditional') THEN 'not_releasable' END, CASE WHEN license IN ('', 'NOASSERTION') THEN 'license_missing' END,
  CASE WHEN coalesce(terms_url, '') = '' THEN 'terms_url_missing' END, CASE WHEN status = 'conditional' AND coalesce(attribution, '') = '' THEN 'attribution_missing' END) AS errors FROM g)"""


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, aliases = V.registry(spark)
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), "text")
    return G.decisions(d, reg, aliases, "dataset").withColumn("errors", G.release_errors())


@query(f"{GOV} SELECT dataset, source_id, status, license, count(*) AS n FROM e GROUP BY ALL")
def license_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir).groupBy("dataset", "source_id", "status", "license").agg(F.count("*").alias("n"))


@query(f"{GOV} SELECT doc_id, dataset, status, license, terms_url, attribution FROM e")
def apply_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir).select("doc_id", "dataset", "status", "license", "terms_url", "attribution")


@query(f"{GOV} SELECT doc_id, errors FROM e")
def release_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query(f"{GOV} SELECT source_id, CASE WHEN status NOT IN ('approved', 'conditional') THEN 'unsupported' WHEN errors <> '' THEN 'rejected' WHEN len(text) < 100 THEN 'filtered' ELSE 'written' END AS outcome, count(*) AS n FROM e GROUP BY ALL")
def build_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(~F.col("status").isin(*G.RELEASABLE), "unsupported").when(F.size("errors") > 0, "rejected").when(F.length("text") < 100, "filtered").otherwise("written")
    return governed(spark, sf_dir).groupBy("source_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))


CATALOG = "WITH rows AS (SELECT source, doc_id, doc_id || ' ' || md5(coalesce(text, '')) AS entry FROM documents), " + tree_sql("rows", "source", "doc_id, entry", "entry", 64)


@query(f"{CATALOG} SELECT sha256(string_agg(line, chr(10) ORDER BY source)) AS catalog, count(*) AS artifacts, sum(n)::BIGINT AS records FROM tree_3")
def release_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact is a source; its digest is a tree over its records in order, so no task has a source's records."""
    rows = V.table(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("entry"))
    artifacts = tree_digest(rows, ["source"], ["doc_id", "entry"], F.col("entry"), 64)
    return G.catalog_hash(artifacts, "source", "digest").join(F.broadcast(artifacts.agg(F.sum("n").alias("records"))))  # one row each


@query("SELECT count(*) FILTER (WHERE trim(props) <> '') AS lines, count(*) FILTER (WHERE NOT json_valid(props)) AS invalid FROM events")
def jsonl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return e.agg(F.count_if(F.trim("props") != "").alias("lines"), F.count_if(F.try_parse_json("props").isNull()).alias("invalid"))


FLAGS = """f AS (SELECT p_partkey AS id, p_size % 2 = 0 AS value_robust, p_size % 3 <> 0 AS content_real, p_size % 11 <> 0 AS correct,
  CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size % 7 <> 0 ELSE true END AS base_clean, p_size % 13 = 0 AS leakage,
  CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS fixable, CASE p_size % 6 WHEN 2 THEN true ELSE NULL END AS arch_specific FROM part),
t AS (SELECT id, CASE WHEN leakage OR base_clean IS NOT DISTINCT FROM false OR NOT correct THEN 'TX' WHEN value_robust AND content_real AND coalesce(arch_specific, false) THEN 'T2'
  WHEN value_robust AND content_real THEN 'T1' WHEN fixable THEN 'T3' WHEN fixable IS NOT DISTINCT FROM false THEN 'T4' ELSE 'T3' END AS tier FROM f)"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    flags = {
        "value_robust": s % 2 == 0, "content_real": s % 3 != 0, "correct": s % 11 != 0,
        "base_clean": F.when(s % 5 == 1, s % 7 != 0).when(s % 5 != 0, True), "leakage": s % 13 == 0,
        "fixable": F.when(s % 4 == 1, True).when(s % 4 != 0, False), "arch_specific": F.when(s % 6 == 2, True),
    }
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(c.alias(k) for k, c in flags.items())).select("id", G.tier().alias("tier"))


@query(f"WITH {FLAGS} SELECT id, tier FROM t")
def source_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir)


@query(f"WITH {FLAGS} SELECT tier, count(*) AS n FROM t GROUP BY 1")
def tier_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"{GOV} SELECT source_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches({V.folded('text')}, '{L.PRICE_PROJECTION.replace(chr(39), chr(39) * 2)}')) AS leaks, any_value(status) AS status FROM e GROUP BY 1")
def discriminator_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(L.has(F.col("text"), L.PRICE_PROJECTION)).alias("leaks"), F.first("status").alias("status"))


@query(f"{GOV} SELECT status, errors AS reason, count(*) AS n FROM e GROUP BY ALL")
def emission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir).groupBy("status", F.array_join("errors", ",").alias("reason")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
