"""The registered queries of this subpackage: op2_packing and so on, over whole tables.

ORACLES holds SQL where SQL can express a query over whole tables; the others are tested against
brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


#: Weights of domains, and of languages in each; sources of a language keep their shares.
DOMAINS, LANGUAGES = {"web": 0.5, "books": 0.3, "forum": 0.2}, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, x): w for d in DOMAINS for x, w in LANGUAGES.items()}
#: Weight of all other languages of a domain together, null too.
UNNAMED = 0.05


def levels() -> dict:
    """Domain, language and source; a source's domain goes by the remainder of its number by 3."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 3
    domain = F.when(number == 0, "web").when(number == 1, "books").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, judged

    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removed

    return removed(table(spark, sf_dir, "documents"), length=50)


def op5_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens: three domains (by source number), languages by weight, sources as they are."""
    from .mixing import mixed
    from .wordpiece import n_tokens

    return mixed(table(spark, sf_dir, "documents"), levels(), n_tokens("text"), WEIGHTS, 0.5, max_epochs=2, seed=1, unnamed=UNNAMED)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    return judged(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixed_blocks import removed

    return removed(table(spark, sf_dir, "documents"), length=13)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import EVERY, variants

    return variants(table(spark, sf_dir, "documents"), every=EVERY)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, (row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id))::INT AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


QUERIES = {f.__name__: f for f in (op1_urls, op2_packing, op3_quality, op4_substrings, op5_wordpiece, op6_mixing, op7_topk, op8_html, op9_rules, op10_jaccard, op11_passages, op12_spelling, op13_negatives)}

ORACLES: dict[str, str] = {"op7_topk": OP7_SQL, "op13_negatives": OP13_SQL}
