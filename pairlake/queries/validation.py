"""Validators over forecast records with seeded defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import validate as C
from ..plans import views as V
from .common import Registry

query = Registry()
ITEM = f"WITH {V.ITEM}, v_n AS (SELECT *, (day(origin) + month(origin) + len(dataset)) % 7 AS k FROM v_item)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with k in 0..6, by their day, which says what is seeded into them."""
    return V.item(spark, sf_dir).withColumn("k", ((F.dayofmonth("origin") + F.month("origin") + F.length("dataset")) % 7).cast("long"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast records; by k: 0 fine, 1 wrong len, 2 bad role, 3 NaN, 4 loss start, 5 a range, 6 no text."""
    k = numbered(spark, sf_dir).select(F.col("series_id").alias("id"), "k")
    r = P.forecast_record(V.item(spark, sf_dir))
    r = r.join(k, r["series_id"] == k["id"]).drop("id")
    one = lambda s: F.struct(
        F.when(F.col("k") == 1, s["len"] + 1).otherwise(s["len"]).alias("len"),
        F.when((F.col("k") == 2) & (s["role"] == "context"), "judge").otherwise(s["role"]).alias("role"),
        F.when(F.col("k") == 3, F.transform(s["values"], lambda x: F.lit(float("nan")))).otherwise(s["values"]).alias("values"),
        F.when((F.col("k") == 4) & (s["role"] == "context"), -1).otherwise(s["loss_start"]).alias("loss_start"),
    )
    r = r.withColumn("timeseries", F.transform("timeseries", one)).withColumn("num_spans", F.lit(2))
    r = r.withColumn("ranges", F.when(F.col("k") == 5, F.array(F.array(F.lit(0), F.lit(3)))).otherwise(F.col("ranges")))
    return r.withColumn("text", F.when(F.col("k") == 6, "").otherwise(F.col("text")))


@query(f"{ITEM} SELECT series_id, k, CASE k WHEN 1 THEN 'span_len,target_prefix,target_loss_start' WHEN 2 THEN 'role' WHEN 3 THEN 'non_finite' WHEN 4 THEN 'loss_start' WHEN 5 THEN 'ranges_not_empty' WHEN 6 THEN 'text_missing,ts_token_count' ELSE '' END AS errors FROM v_n")
def validate_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("series_id", "k", F.array_join(C.chatml_errors(), ",").alias("errors"))


@query(f"{ITEM} SELECT k, count(*) AS n FROM v_n WHERE k > 0 GROUP BY 1")
def check_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fail, by their defect: all that have one, no others."""
    r = records(spark, sf_dir)
    return r.where(F.size(C.chatml_errors()) > 0).groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(f"{ITEM}, e AS (SELECT series_id, CASE WHEN k = 0 AND len(text) = 0 THEN 'answer_missing' WHEN k = 1 THEN 'future_invalid' WHEN k = 2 THEN 'kind_unknown' ELSE '' END AS errors FROM v_n) SELECT * FROM e")
def validate_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered(spark, sf_dir)
    kind = F.when(F.col("k") == 0, "ts_to_text").when(F.col("k") == 2, "other").otherwise("text_to_ts")
    future = F.when(F.col("k") == 1, F.array().cast("array<double>")).otherwise(F.col("future"))
    return n.select("series_id", F.array_join(C.example_errors(kind, F.col("text"), F.col("history"), future), ",").alias("errors"))


@query(f"{ITEM} SELECT series_id, k <> 3 AS finite FROM v_n")
def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.series import finite

    bad = F.transform("history", lambda x: F.lit(float("inf")))
    return numbered(spark, sf_dir).select("series_id", finite(F.when(F.col("k") == 3, bad).otherwise(F.col("history"))).alias("finite"))


@query("SELECT conv_id, role, CASE WHEN role = 'user' THEN 'chatml' WHEN turn % 2 = 1 THEN 'cpt' ELSE 'unknown' END AS format, count(*) AS n FROM conversations GROUP BY ALL")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.lit(P.USER)).otherwise("")
    none = F.array().cast("array<struct<role:string,freq:string>>")
    task = F.when(F.col("turn") % 2 == 1, "world_knowledge")
    return c.groupBy("conv_id", "role", C.format_of(text, none, task).alias("format")).agg(F.count("*").alias("n"))


CPT = ITEM + """, c AS (SELECT series_id, CASE WHEN k = 1 THEN 'x' WHEN k = 2 THEN '1m' ELSE '1d' END AS freq, CASE WHEN k = 3 THEN history[1:1] WHEN k = 4 THEN history[1:3] ELSE history END AS v, CASE WHEN k = 5 THEN 2 ELSE 1 END AS toks FROM v_n),
e AS (SELECT series_id, concat_ws(',', CASE WHEN toks <> 1 THEN 'ts_token_count' END, CASE WHEN freq = 'x' THEN 'bad_freq' END, CASE WHEN len(v) = 1 THEN 'single_point_series' END,
  CASE WHEN len(v) BETWEEN 2 AND 7 THEN 'short_series' END, CASE WHEN freq = '1m' THEN 'freq_period_mismatch' END) AS codes FROM c)"""


def _cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = numbered(spark, sf_dir), F.col("k")
    freq = F.when(k == 1, "x").when(k == 2, "1m").otherwise("1d")
    values = F.when(k == 3, F.slice("history", 1, 1)).when(k == 4, F.slice("history", 1, 3)).otherwise(F.col("history"))
    text = P.pretraining_text(F.concat(F.lit("t"), "text"), F.when(k == 5, 2).otherwise(1))
    return n.select("series_id", C.channel_checks(text, freq, values, F.lit(9), 8).alias("codes"))


@query(f"{CPT} SELECT * FROM e")
def check_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpt(spark, sf_dir).select("series_id", F.array_join("codes", ",").alias("codes"))


@query(f"{CPT} SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes, ',')) AS code FROM e WHERE codes <> '') GROUP BY 1")
def audit_file_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpt(spark, sf_dir).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"{ITEM} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE k > 0) AS with_errors, median(len(history)) AS median_len, round(count(DISTINCT text) / count(*), 6) AS unique_ratio FROM v_n GROUP BY 1")
def audit_file_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("bad", F.size(C.chatml_errors()) > 0).select("series_id", "bad")
    i = V.item(spark, sf_dir).select(F.col("series_id").alias("id"), "dataset", F.size("history").alias("len"), "text")
    j = i.join(r, i["id"] == r["series_id"])
    return j.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("bad").alias("with_errors"), F.median("len").alias("median_len"), F.round(F.countDistinct("text") / F.count("*"), 6).alias("unique_ratio"))


@query(f"{ITEM} SELECT series_id, date_diff('day', kt, origin)::INT AS days FROM v_item")
def span_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.item(spark, sf_dir).select("series_id", F.abs(F.datediff("origin", "kt")).alias("days"))


@query(f"{ITEM} SELECT series_id, list_contains(list_transform(history, lambda v: round(v, 2)), round(history[3], 2)) AS recites FROM v_n")
def recites_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("series_id", C.recites(F.col("history"), F.array(F.get("history", F.lit(2)))).alias("recites"))


@query(f"{ITEM} SELECT series_id, concat_ws(',', CASE WHEN k = 1 THEN 'missing_provenance' END, CASE WHEN kt IS NULL THEN 'missing_kt' END, CASE WHEN k = 2 THEN 'text_quality_enum' END) AS codes FROM v_n")
def shared_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = numbered(spark, sf_dir), F.col("k")
    quality = F.when(k == 2, "poor").otherwise("real")
    bad = C.codes((k == 1, "missing_provenance"), (F.col("kt").isNull(), "missing_kt"), (~quality.isin(*C.QUALITIES["chatml"]), "text_quality_enum"))
    return n.select("series_id", F.array_join(bad, ",").alias("codes"))


@query(f"{ITEM} SELECT dataset, CASE WHEN kt IS NULL THEN 'missing_kt' WHEN kt >= origin THEN 'leak' ELSE 'ok' END AS verdict, count(*) AS n FROM v_item GROUP BY ALL")
def leakage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("kt").isNull(), "missing_kt").when(F.col("kt") >= F.col("origin"), "leak").otherwise("ok")
    return V.item(spark, sf_dir).groupBy("dataset", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"{ITEM} SELECT k % 2 = 0 AS flywheel, count(*) AS n, count(*) FILTER (WHERE kt IS NULL OR (kt + (k % 3)::INT) >= origin) AS leaks FROM v_n GROUP BY 1")
def audit_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("kt").isNull() | (F.date_add("kt", (F.col("k") % 3).cast("int")) >= F.col("origin"))
    return numbered(spark, sf_dir).groupBy((F.col("k") % 2 == 0).alias("flywheel")).agg(F.count("*").alias("n"), F.count_if(late).alias("leaks"))


QUERIES, ORACLES = query.queries, query.oracles
