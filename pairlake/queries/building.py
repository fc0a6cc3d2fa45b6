"""Converters between formats, text builders, gates of the emitted records, and the small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..functions import series as S
from ..operators import emit as M
from ..operators import pairs as P
from ..operators import validate as C
from ..operators.retrieve import verdict_key
from ..plans import views as V
from . import lexical as Q
from .common import Registry, r6
from .validation import numbered, records

query = Registry()
ITEM = f"WITH {V.ITEM}"
NUMBERED = f"{ITEM}, v_n AS (SELECT *, (day(origin) + month(origin) + len(dataset)) % 7 AS k FROM v_item)"
NORM = NUMBERED + """, v_dev AS (SELECT *, list_avg(history) AS m FROM v_n), v_sd AS (SELECT *, sqrt(list_avg(list_transform(history, lambda x: pow(x - m, 2)))) AS sd FROM v_dev),
v_norm AS (SELECT *, greatest(sd, 1e-3 * greatest(abs(m), 1)) AS std FROM v_sd)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.item(spark, sf_dir)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


# converters


@query(f"{NUMBERED} SELECT series_id, 'pairlake@1' AS builder, 'pair@1' AS pair_schema_version, dataset AS text_source, CASE WHEN k % 3 = 0 THEN 'derived_generated' ELSE 'real' END AS is_generated_text, CASE WHEN k % 3 = 0 THEN 'derived' ELSE 'real' END AS text_quality, kt AS knowledge_time FROM v_n")
def prov_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered(spark, sf_dir).withColumn("generated", F.when(F.col("k") % 3 == 0, "derived_generated").otherwise("real"))
    return M.stamped(n, F.col("dataset"), F.col("generated"), F.col("kt")).select("series_id", "builder", "pair_schema_version", "text_source", "is_generated_text", "text_quality", "knowledge_time")


SCORED = Q.SCORE.replace(f"WITH {V.TEXT}", f"{ITEM}, v_text AS (SELECT article_id AS id, {V.folded('title')} AS txt, strftime(day, '%Y-%m-%d') AS event_date FROM v_article)")


@query(f"""{SCORED}, l AS (SELECT day, max(article_id) AS id FROM v_article GROUP BY 1) SELECT i.series_id,
  md5('<|im_start|>user' || chr(10) || i.text || chr(10) || '(history=<ts></ts>)<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<ts></ts><|im_end|>' || chr(10)) AS text_md5, 'ts_forecast' AS task_type,
  'context 10 10,target 15 10' AS spans, 0 AS n_ranges, s.label AS text_ts_match, s.score AS text_ts_match_score, 'review_required' AS license_status FROM v_item i LEFT JOIN l ON i.kt = l.day LEFT JOIN s ON s.id = l.id""")
def emit_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast records: text, spans (role, length, start of the loss), ranges, the match score of what stands before the first marker, licence."""
    a = V.article(spark, sf_dir)
    latest = a.groupBy("day").agg(F.max("article_id").alias("latest")).withColumnRenamed("day", "kt")
    cause = P.before_any(F.col("title"), M.CAUSE_CUTS)
    scored = a.select("article_id", *(c.alias(k) for k, c in L.score(F.trim(cause), F.date_format("day", "yyyy-MM-dd")).items()))
    r = P.forecast_record(items(spark, sf_dir)).join(latest, "kt", "left").join(scored, F.col("latest") == F.col("article_id"), "left")
    spans = F.array_join(F.transform("timeseries", lambda s: F.concat_ws(" ", s["role"], s["len"].cast("string"), s["loss_start"].cast("string"))), ",")
    return r.select("series_id", F.md5("text").alias("text_md5"), "task_type", spans.alias("spans"), F.size("ranges").alias("n_ranges"), F.col("label").alias("text_ts_match"), F.col("score").alias("text_ts_match_score"), F.lit("review_required").alias("license_status"))


@query(f"{NUMBERED}, f AS (SELECT series_id, k, CASE k % 3 WHEN 0 THEN 'chatml' WHEN 1 THEN 'cpt' ELSE 'ir' END AS format, CASE WHEN k = 6 THEN 'ts_to_text' ELSE 'text_to_ts' END AS kind FROM v_n) SELECT series_id, format, kind, CASE WHEN format = 'cpt' AND kind = 'text_to_ts' THEN 'unsupported' ELSE 'emitted' END AS outcome FROM f")
def emit_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.when(F.col("k") % 3 == 0, "chatml").when(F.col("k") % 3 == 1, "cpt").otherwise("ir")
    kind = F.when(F.col("k") == 6, "ts_to_text").otherwise("text_to_ts")
    return numbered(spark, sf_dir).select("series_id", fmt.alias("format"), kind.alias("kind")).withColumn("outcome", M.dispatched(F.col("kind"), F.col("format")))


@query(f"{NUMBERED} SELECT series_id, CASE WHEN k = 5 THEN '' ELSE 'pair@1' END AS schema_version, CASE WHEN k = 5 THEN 'history_invalid' ELSE '' END AS errors FROM v_n")
def ir_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid examples as JSON records; what isn't valid gives its errors instead."""
    n = numbered(spark, sf_dir).withColumn("history", F.when(F.col("k") == 5, F.slice("history", 1, 1)).otherwise(F.col("history")))
    r = M.to_record(n.withColumn("kind", F.lit("text_to_ts")))
    return r.select("series_id", F.coalesce(F.get_json_object("record", "$.schema_version"), F.lit("")).alias("schema_version"), F.array_join("errors", ",").alias("errors"))


@query(f"{NUMBERED} SELECT series_id, CASE k WHEN 1 THEN 'schema_version' WHEN 2 THEN 'kind' WHEN 3 THEN 'payload' WHEN 4 THEN 'future_invalid' ELSE '' END AS error, CASE WHEN k IN (1, 2, 3, 4) THEN NULL ELSE round(list_sum(history) * 0.137931, 3) END AS total FROM v_n")
def ir_from_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back, some with another version, an unknown kind, no payload, or a payload that isn't valid."""
    k = F.col("k")
    n = numbered(spark, sf_dir).withColumn("future", F.when(k == 4, F.array().cast("array<double>")).otherwise(F.col("future")))
    payload = F.when(k != 3, F.struct("history", "future", "text", "kt"))
    raw = F.struct(F.when(k == 1, "pair@0").otherwise("pair@1").alias("schema_version"), F.when(k == 2, "other").otherwise("text_to_ts").alias("kind"), payload.alias("payload"))
    r = M.from_record(n.select("series_id", F.to_json(raw).alias("record")))
    return r.select("series_id", F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), F.round(S.total(F.col("payload.history")) * 0.137931, 3)).alias("total"))


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(replace(t, '<ts></ts>', ' ')), '\\s+([.,;:])', '\\1', 'g'), '[:\\-–—]\\s*\\.', '.', 'g'), '\\s{2,}', ' ', 'g'), '\\bat\\s*\\.', '.', 'g'))"


@query(f"{ITEM}, c AS (SELECT series_id, history, rtrim(text, '. ') || '. <ts></ts>' AS t FROM v_item), a AS (SELECT series_id, history, t, {CLEAN} AS answer FROM c) SELECT series_id, md5(answer) AS answer_md5, len(history) AS n, CASE WHEN contains(t, '<ts></ts>') AND NOT regexp_matches(t, '[:.]\\s*<ts></ts>') THEN 'ts_mid_sentence' ELSE 'ok' END AS note FROM a WHERE len(answer) >= 10")
def cpt_to_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretraining records as description records: the answer cleaned of series tokens, ten characters at least."""
    c = items(spark, sf_dir).select("series_id", "history", P.pretraining_text(F.col("text"), F.lit(1)).alias("text"))
    out = M.described(c)
    return out.select("series_id", F.md5("answer").alias("answer_md5"), F.size("values").cast("long").alias("n"), "note")


@query(f"{ITEM}, c AS (SELECT series_id, rtrim(text, '. ') || '. <ts></ts>' AS t FROM v_item), a AS (SELECT series_id, {CLEAN} AS answer FROM c) SELECT count(*) AS converted, 0::BIGINT AS with_errors FROM a WHERE len(answer) >= 10")
def convert_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the converter makes is checked by the other format's checker."""
    c = items(spark, sf_dir).select("series_id", "dataset", "origin", "kt", "future", F.col("history"), P.pretraining_text(F.col("text"), F.lit(1)).alias("text"))
    made = M.described(c).withColumn("text", F.col("answer")).withColumn("history", F.col("values"))
    r = P.description_record(made).withColumn("num_spans", F.lit(1)).withColumn("bad", F.size(C.chatml_errors()) > 0)
    return r.agg(F.count("*").alias("converted"), F.count_if("bad").alias("with_errors"))


@query(f"{NUMBERED} SELECT series_id, CASE WHEN k = 6 THEN md5('no turn here') ELSE md5(text || chr(10) || '(history=<ts></ts>)') END AS text_md5 FROM v_n")
def audit_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turn, else the whole text."""
    r = records(spark, sf_dir).withColumn("text", F.when(F.col("k") == 6, "no turn here").otherwise(F.col("text")))
    return r.select("series_id", F.md5(M.user_text(F.col("text"))).alias("text_md5"))


@query(f"{ITEM} SELECT series_id, md5(text) AS cause_md5 FROM v_item WHERE NOT regexp_matches(text, '\\s+Given this context')")
def qa_cause_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turn before "Given this context"."""
    i = items(spark, sf_dir).where(~F.col("text").rlike(r"\s+Given this context")).withColumn("text", F.concat("text", F.lit(" Given this context and the history, forecast.")))
    return P.forecast_record(i).select("series_id", F.md5(M.qa_cause(F.col("text"))).alias("cause_md5"))


@query("WITH d AS (SELECT doc_id, 'Prediction target period x. ' || CASE WHEN doc_id % 2 = 0 THEN 'Recent related events: ' ELSE '' END || coalesce(text, '') AS s FROM documents) SELECT doc_id, md5(trim(CASE WHEN contains(s, 'Recent related events') THEN substr(s, strpos(s, 'Recent related events')) ELSE s END, chr(32) || chr(10) || chr(9) || chr(13))) AS fact_md5 FROM d")
def scenario_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("Prediction target period x. "), F.when(F.col("doc_id") % 2 == 0, "Recent related events: ").otherwise(""), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(M.fact(s)).alias("fact_md5"))


@query("SELECT doc_id, concat_ws('  ', CASE WHEN lower(coalesce(lang, '')) NOT IN ('', 'unknown') THEN lang END, CASE WHEN doc_id % 3 <> 0 AND coalesce(source, '') <> '' THEN source END) AS preds FROM documents")
def scenario_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", M.predictions(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "Unknown").otherwise(F.col("source"))).alias("preds"))


TIMESX = """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, lang FROM documents), q AS (SELECT o_custkey AS id, list(o_totalprice ORDER BY o_orderkey) AS s FROM orders GROUP BY 1),
x AS (SELECT doc_id, source, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) AS fact, lang AS preds, list_slice(s, len(s) - 14, len(s) - 5) AS history, list_slice(s, len(s) - 4, len(s)) AS future FROM d JOIN q ON d.doc_id = q.id WHERE len(s) >= 15),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM x WHERE fact <> '')"""


@query(f"{TIMESX} SELECT doc_id, source, round(list_sum(history) * 0.137931, 3) AS history, round(list_sum(future) * 0.137931, 3) AS future, md5(trim(substr(fact, 1, 1200) || ' ' || preds)[:1600]) AS text_md5 FROM r WHERE n <= 5 OR pos IN (SELECT i * r.n // 5 FROM range(5) t(i))")
def timesx_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with an event, ten past and five coming points and a fact; five a source at most, spread evenly."""
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    o = o.select("id", F.transform("a", lambda x: x["o_totalprice"]).alias("s"), F.size("a").alias("n"))
    d = documents(spark, sf_dir).join(o, F.col("doc_id") == F.col("id"))
    past, future = F.slice("s", 1, F.greatest(F.col("n") - 5, F.lit(0))), F.slice("s", F.greatest(F.col("n") - 4, F.lit(1)), F.lit(5))
    d = d.withColumns({"past": past, "future": future, "fact": M.fact(F.col("text")), "preds": F.col("lang"), "events": F.lit(1)})
    out = M.samples(d, 10, 5, ["source"], ["doc_id"], 5)
    return out.select("doc_id", "source", F.round(S.total(F.col("history")) * 0.137931, 3).alias("history"), F.round(S.total(F.col("future")) * 0.137931, 3).alias("future"), F.md5("text").alias("text_md5"))


@query(f"{ITEM} SELECT series_id, kt AS knowledge_time, round(list_sum(history) * 0.137931, 3) AS history, md5(trim(text, chr(32) || chr(10) || chr(9) || chr(13))[:1600]) AS text_md5 FROM v_item WHERE kt IS NOT NULL")
def timemmd_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the latest report before their origin; without one there is no sample."""
    i = items(spark, sf_dir).where("kt is not null")
    text = F.substring(M.stripped(F.col("text")), 1, 1600)
    return i.select("series_id", F.col("kt").alias("knowledge_time"), F.round(S.total(F.col("history")) * 0.137931, 3).alias("history"), F.md5(text).alias("text_md5"))


# statistics of records


@query(f"{NORM} SELECT series_id, round(m, 5) AS mean, round(std, 5) AS std FROM v_norm")
def stats_map_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each series' first span; the last record written of a series wins."""
    r = P.forecast_record(items(spark, sf_dir)).select("series_id", "mean", "std")
    old = r.select("series_id", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"), F.lit(0).alias("at"))
    m = M.stats_map(old.union(r.withColumn("at", F.lit(1))), "at")
    return m.select("series_id", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"{NORM} SELECT series_id, 0 AS span_idx, 'user' AS speaker, 'context' AS role, round(m, 5) AS mean, round(std, 5) AS std, len(history)::INT AS raw_len, len(history)::INT AS loss_start, std > sd AS std_floor_applied, 'self' AS renorm_source, true AS stats_visible, false AS stats_supervised FROM v_norm")
def span_norm_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("m", S.mean(F.col("history"))).withColumn("sd", S.std(F.col("history")))
    s = M.span_norm(0, "user", "context", F.col("m"), F.col("sd"), F.size("history"), F.size("history"), "self", True)
    i = i.withColumn("s", s).select("series_id", "s.*")
    return i.withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5)).drop("reference_span_idx")


@query(f"{NORM} SELECT series_id, len(history) + 5 AS n, round((list_sum(history) + list_min(history) + list_max(history) + m + history[1] + history[10]) * 0.137931, 2) AS total FROM v_norm")
def raw_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text may state: values, least, most, mean, first and last."""
    r = items(spark, sf_dir).withColumn("pool", M.raw_pool(F.col("history")))
    return r.select("series_id", F.size("pool").cast("long").alias("n"), F.round(S.total(F.col("pool")) * 0.137931, 2).alias("total"))


@query(f"{NORM} SELECT series_id, round(list_sum(history) * 0.137931, 2) AS history, round(list_sum(future) * 0.137931, 2) AS future FROM v_norm WHERE k <> 0")
def export_chattime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in raw units; a series without known statistics is skipped."""
    r = P.forecast_record(items(spark, sf_dir)).select("series_id", F.transform(F.col("timeseries")[1]["values"], lambda v: v).alias("z"))
    known = P.forecast_record(numbered(spark, sf_dir).where("k <> 0")).select(F.col("series_id").alias("known"), "mean", "std")
    exact = items(spark, sf_dir).select(F.col("series_id").alias("own"), "history", "future")
    j = r.join(known, F.col("series_id") == F.col("known")).join(exact, F.col("series_id") == F.col("own"))
    raw = P.denormalised(F.col("z"), F.col("mean"), F.col("std"))
    near = F.forall(F.zip_with(raw, F.concat("history", "future"), lambda a, b: F.abs(a - b) <= 1e-5 * F.col("std") + 1e-6), lambda x: x)
    return j.where(near).select("series_id", F.round(S.total(F.col("history")) * 0.137931, 2).alias("history"), F.round(S.total(F.col("future")) * 0.137931, 2).alias("future"))


@query(f"{ITEM} SELECT series_id, round(list_sum(history[3:]) * 0.137931, 3) AS history, round(list_sum(future[:3]) * 0.137931, 3) AS future FROM v_item")
def load_arms_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.rectangular(items(spark, sf_dir), 8, 3)
    return f.select("series_id", F.round(S.total(F.col("history")) * 0.137931, 3).alias("history"), F.round(S.total(F.col("future")) * 0.137931, 3).alias("future"))


@query(f"{ITEM} SELECT series_id, count(*) AS n, round(sum(list_sum(history[-8:]) - list_sum(future[:3])) / 1e6, 4) AS fall FROM v_point WHERE len(history) >= 8 AND len(future) >= 3 GROUP BY 1")
def load_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight points and three to come, cut to them; shorter ones are left out."""
    f = M.rectangular(V.ragged(spark, sf_dir), 8, 3)
    return f.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum(S.total(F.col("history")) - S.total(F.col("future"))) / 1e6, 4).alias("fall"))


# gates


@query(f"""{NUMBERED} SELECT series_id, CASE WHEN k IN (1, 2) THEN 'cpt' WHEN k = 3 THEN 'ir' WHEN k = 4 THEN 'other' ELSE 'chatml' END AS format,
  CASE k WHEN 1 THEN 'placeholder_count' WHEN 2 THEN 'task_type,timeseries_missing,placeholder_count' WHEN 3 THEN CASE WHEN day(origin) % 2 = 0 THEN 'future_invalid' ELSE '' END
    WHEN 4 THEN 'unknown_format' WHEN 5 THEN 'ranges_not_empty' WHEN 6 THEN 'text_missing,ts_token_count' ELSE '' END AS errors FROM v_n""")
def validate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three formats and of an unknown one, each by its own gate; all codes stay."""
    n, k = numbered(spark, sf_dir), F.col("k")
    cpt = n.where("k in (1, 2)").select("series_id", F.when(k == 2, "other").otherwise("world_knowledge").alias("task_type"), P.pretraining_text(F.col("text"), F.when(k == 1, 2).otherwise(1)).alias("text"), F.when(k == 1, 1).otherwise(0).alias("channels"))
    future = F.when(F.dayofmonth("origin") % 2 == 0, F.slice("future", 1, 0)).otherwise(F.col("future"))
    ir = n.where("k = 3").select("series_id", F.lit("text_to_ts").alias("kind"), "text", "history", future.alias("future"))
    found = C.output_errors({"chatml": records(spark, sf_dir).where("k in (0, 5, 6)"), "cpt": cpt, "ir": ir, "other": n.where("k = 4")}, "series_id")
    return found.select("series_id", "format", F.array_join("errors", ",").alias("errors"))


@query(f"{NUMBERED} SELECT series_id, dataset, CASE WHEN k % 2 = 0 THEN 'chatml' ELSE 'cpt' END AS fmt, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n_series, CASE WHEN k % 2 = 0 THEN 25 ELSE 10 END AS points, CASE WHEN k % 2 = 0 THEN 'ts_forecast' ELSE 'world_knowledge' END AS task_type, kt AS knowledge_time FROM v_n")
def common_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection of both formats: what the shared checks read."""
    n = numbered(spark, sf_dir)
    chat = P.forecast_record(n.where("k % 2 = 0")).select("series_id", "dataset", F.lit("chatml").alias("fmt"), F.transform("timeseries", lambda s: F.size(s["values"])).alias("series_len"), "task_type", F.col("kt").alias("knowledge_time"))
    cpt = n.where("k % 2 = 1").select("series_id", "dataset", F.lit("cpt").alias("fmt"), F.array(F.size("history")).alias("series_len"), F.lit("world_knowledge").alias("task_type"), F.col("kt").alias("knowledge_time"))
    both = chat.unionByName(cpt)
    points = F.aggregate("series_len", F.lit(0), lambda a, x: a + x)
    return both.select("series_id", "dataset", "fmt", F.size("series_len").alias("n_series"), points.alias("points"), "task_type", "knowledge_time")


GATED = f"""{NUMBERED}, v_gate AS (SELECT series_id, dataset, origin, kt, k, CASE k WHEN 1 THEN 'span_len,target_prefix,loss_start' WHEN 2 THEN 'one_context' WHEN 3 THEN 'non_finite' WHEN 4 THEN 'loss_range,loss_start'
  WHEN 5 THEN 'ranges_not_empty' WHEN 6 THEN 'placeholder_count' ELSE '' END AS errors FROM v_n)"""


@query(f"{GATED} SELECT series_id, errors FROM v_gate")
def qa_schema_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third check of forecast records, made from the rules anew."""
    return records(spark, sf_dir).select("series_id", F.array_join(C.forecast_errors(), ",").alias("errors"))


@query(f"{GATED} SELECT series_id, concat_ws(',', nullif(errors, ''), CASE WHEN kt IS NULL THEN 'missing_knowledge_time' END) AS errors FROM v_gate")
def qa_schema_forecast_kt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("series_id", F.array_join(C.forecast_errors(knowledge_time=True), ",").alias("errors"))


@query(f"{GATED} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE errors <> '' OR kt IS NULL) AS bad, count(*) FILTER (WHERE kt IS NULL OR kt >= origin) AS leaks, bool_and(errors = '' AND kt IS NOT NULL AND kt < origin) AS pass FROM v_gate GROUP BY 1")
def qa_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema and leakage of each dataset's records; a dataset passes without any fault."""
    r = records(spark, sf_dir).withColumn("bad", F.size(C.forecast_errors(knowledge_time=True)) > 0)
    leak = F.col("kt").isNull() | (F.col("kt") >= F.col("origin"))
    return r.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(leak).alias("leaks"), F.bool_and(~F.col("bad") & ~leak).alias("pass"))


WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z''-]{{2,}}'), lambda w: NOT list_contains(['the', 'and', 'for', 'was', 'with'], w)))"
RELEVANCE = f"""WITH w AS (SELECT doc_id, source, {WORDS.format("coalesce(split_part(text, chr(10), 1), '')")} AS lead, {WORDS.format("coalesce(text, '')")} AS event, {WORDS.format("coalesce(lang, '')")} AS title FROM documents),
x AS (SELECT doc_id, source, list_filter(lead, lambda q: NOT list_contains(title, q)) AS lead, list_filter(event, lambda q: NOT list_contains(title, q)) AS event FROM w),
v_rel AS (SELECT doc_id, source, CASE WHEN len(event) > 0 THEN round(len(list_intersect(lead, event)) / len(event), 3) END AS relevance FROM x)"""


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", "source", M.lead_relevance(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), F.coalesce("lang", F.lit(""))).alias("relevance"))


@query(f"{RELEVANCE} SELECT doc_id, relevance, coalesce(relevance >= 0.15, false) AS event_aware FROM v_rel")
def lead_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a text's content words that its first line has, the title's left out."""
    return relevant(spark, sf_dir).select("doc_id", "relevance", F.coalesce(F.col("relevance") >= 0.15, F.lit(False)).alias("event_aware"))


@query(f"{RELEVANCE} SELECT source, count(*) AS n, count(relevance) AS scored, count(*) FILTER (WHERE relevance >= 0.15) AS event_aware, bool_and(coalesce(relevance >= 0.15, false)) AS pass FROM v_rel GROUP BY 1")
def qa_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relevant(spark, sf_dir)
    aware = F.coalesce(F.col("relevance") >= 0.15, F.lit(False))
    return r.groupBy("source").agg(F.count("*").alias("n"), F.count("relevance").alias("scored"), F.count_if(aware).alias("event_aware"), F.bool_and(aware).alias("pass"))


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\\d+(?:\\.\\d+)?)[^.\\d\\n]{0,12}?((?:19|20)\\d{2})', 1) AS v, regexp_extract_all(coalesce(text, ''), '(\\d+(?:\\.\\d+)?)[^.\\d\\n]{0,12}?((?:19|20)\\d{2})', 2) AS y FROM documents)
SELECT doc_id, len(list_filter(range(1, len(v) + 1), lambda i: list_contains(['2019', '2020', '2021'], y[i]) AND NOT abs(v[i]::DOUBLE - CASE y[i] WHEN '2019' THEN 10.0 WHEN '2020' THEN 25.0 ELSE 394.3 END) <= greatest(0.5, 0.01 * CASE y[i] WHEN '2019' THEN 10.0 WHEN '2020' THEN 25.0 ELSE 394.3 END)
  AND (abs(v[i]::DOUBLE - 10.0) <= 0.5 OR abs(v[i]::DOUBLE - 25.0) <= 0.5 OR abs(v[i]::DOUBLE - 394.3) <= 3.943))) AS n_errors FROM p""")
def year_value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand by a year and are another labelled year's."""
    return documents(spark, sf_dir).select("doc_id", F.size(L.year_value_errors(F.col("text"), {2019: 10.0, 2020: 25.0, 2021: 394.3})).cast("long").alias("n_errors"))


RICH = L.RICH_DIRECTION.replace("'", "''")


@query(f"""WITH d AS (SELECT doc_id, {V.folded("coalesce(text, '')")} AS t FROM documents), s AS (SELECT doc_id, t, regexp_extract_all(t, '(?i){RICH}') AS v, regexp_split_to_array(t, '(?i){RICH}') AS g FROM d),
w AS (SELECT doc_id, t, list_transform(range(1, len(v) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: len(x))), 0), 'n': len(v[i])}}) AS spots FROM s)
SELECT doc_id, regexp_matches(t, '{L.PRICE_FIGURE}') OR len(list_filter(spots, lambda p: regexp_matches(substr(t, greatest(p.a - 40, 0)::BIGINT + 1, (p.a + p.n + 15 - greatest(p.a - 40, 0))::BIGINT), '{L.ASSET}'))) > 0 AS leak FROM w""")
def rich_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price figure, or a direction verb with an asset word near it."""
    return documents(spark, sf_dir).select("doc_id", L.rich_leak(F.col("text")).alias("leak"))


CACHED = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT item_id, text FROM benchmark)"


@query(f"{CACHED} SELECT doc_id, md5(coalesce(c.text, d.text)) AS text_md5, CASE WHEN c.text IS NULL THEN 'real' ELSE 'derived_generated' END AS tag FROM d LEFT JOIN c ON d.doc_id = c.item_id")
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached summary where there is one, else the text itself as real."""
    cache = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("answer"))
    out = M.completed(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", cache)
    return out.select("doc_id", F.md5(F.coalesce("answer", "text")).alias("text_md5"), F.when(F.col("answer").isNull(), "real").otherwise("derived_generated").alias("tag"))


ASKED = """WITH r AS (SELECT conv_id, turn, substr(sha1('chat||' || coalesce(text, '')), 1, 16) AS key FROM conversations WHERE role = 'user'),
c AS (SELECT key, min(a.text) AS answer FROM r JOIN conversations a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant' WHERE a.text IS NOT NULL GROUP BY 1)"""


@query(f"{ASKED} SELECT conv_id, turn, key, answer IS NOT NULL AS cached, md5(answer) AS answer_md5 FROM r LEFT JOIN c USING (key)")
def llm_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of user turns come from a cache alone, here of the answers that conversations hold; a turn that none follows has none."""
    t = V.table(spark, sf_dir, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", verdict_key(F.lit("chat"), F.array(F.coalesce("text", F.lit("")))).alias("key"))
    said = t.where("role = 'assistant' and text is not null").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    cache = asked.join(said, ["conv_id", "turn"]).select("key", "answer")
    return M.completed(asked, "key", cache).select("conv_id", "turn", "key", F.col("answer").isNotNull().alias("cached"), F.md5("answer").alias("answer_md5"))


@query("""WITH v AS (SELECT l_orderkey AS id, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS v FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1),
f AS (SELECT id, list_distinct(list_transform(list_concat(v, [v[1], v[-1], list_min(v), list_max(v), v[-1] - v[1], abs(v[-1] - v[1])]), lambda x: round(x, 2))) AS f FROM v)
SELECT id, len(f)::INT AS n, round(list_sum(f), 2) AS total, list_min(f) AS least, list_max(f) AS most FROM f""")
def series_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that a text about each order's prices may state."""
    lines = V.table(spark, sf_dir, "lineitem").where("l_extendedprice is not null")
    v = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("v"))  # an order's lines
    f = v.select("id", L.series_facts(F.col("v.l_extendedprice")).alias("f"))
    return f.select("id", F.size("f").alias("n"), F.round(S.total(F.col("f")), 2).alias("total"), F.array_min("f").alias("least"), F.array_max("f").alias("most"))


# text builders


#: Wikitext round a document's own text: templates in templates, files, links, references, tables, quotes and tags.
WIKI = ("{{a|{{b|", "source", "}}}} <!-- no --> ", "text", " [[File:x.png|thumb|[[y]]]] [[Target|", "source", "]] [[", "lang", "]] '''", "lang", "''' <ref name=a/> <ref>z</ref> [https://x.org ", "lang", "] {| t |} <b>", "source", "</b>")
_RAW = " || ".join(x if x in ("source", "lang", "text") else "'{}'".format(x.replace("'", "''")) for x in WIKI)


def _stripped(text: str) -> str:
    for pattern, by in L.WIKITEXT:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), by.replace("$", "\\"))
    return f"trim({text}, ' ' || chr(10) || chr(9) || chr(13))"


@query(f"WITH w AS (SELECT doc_id, {_RAW} AS raw FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)), t AS (SELECT doc_id, {_stripped('raw')} AS plain FROM w) SELECT doc_id, length(plain) AS n_chars, md5(plain) AS text_md5 FROM t")
def wikitext_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text in wikitext, stripped to what a reader sees."""
    raw = F.concat(*(F.coalesce(F.col(x), F.lit("")) if x in ("source", "lang", "text") else F.lit(x) for x in WIKI))
    return documents(spark, sf_dir).select("doc_id", L.wikitext(raw).alias("plain")).select("doc_id", F.length("plain").cast("long").alias("n_chars"), F.md5("plain").alias("text_md5"))


STATED = ("<p class=d>For release at 2:00 p.m. EDT <b>Share</b> Information of meeting ", " suggests that &quot;growth&quot; &amp; prices were stable.</p>", "<p>The Committee met as planned. It decided to keep the target range for the federal funds rate at ", " to 99 percent. It will look on.</p>")
ROSTER = ("<p>Voting for this action were the members of the board and many others.</p>", "<p>Board of Governors of the system, and an address of forty letters.</p>")
_PARTS = "'{}' || page_id || '{}' || coalesce(html, '') || '{}' || page_id || '{}'".format(*STATED)
_PAGE = f"CASE WHEN page_id % 4 = 0 THEN coalesce(html, '') ELSE {_PARTS} || CASE page_id % 4 WHEN 1 THEN '{ROSTER[0]}' WHEN 2 THEN '{ROSTER[1]}' ELSE '' END || coalesce(html, '') END"


@query(f"""WITH h AS (SELECT page_id, {_PAGE} AS html FROM pages),
p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')), lambda x: len(x) > 40) AS p FROM h),
s AS (SELECT *, coalesce(list_position(list_transform(p, lambda x: regexp_matches(x, 'For .*?release.*?\\bShare\\b')), true), 0) AS start FROM p),
r AS (SELECT *, CASE WHEN start = 0 THEN [] ELSE p[start + 1:] END AS rest FROM s),
e AS (SELECT *, coalesce(nullif(list_position(list_transform(rest, lambda x: starts_with(lower(x), 'voting for') OR starts_with(x, 'Board of Governors')), true), 0), len(rest) + 1) AS stop FROM r),
b AS (SELECT *, CASE WHEN start = 0 THEN '' ELSE array_to_string(list_filter(list_concat([regexp_extract(p[start], 'For .*?release.*?\\bShare\\b\\s*(.*)', 1)], rest[1:stop - 1]), lambda x: x <> ''), ' ') END AS statement FROM e)
SELECT page_id, len(p) AS n_paragraphs, length(statement) AS n_chars, md5(statement) AS statement_md5,
  coalesce(list_filter(string_split(regexp_replace(statement, '([.])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), 'target range for the federal funds rate'))[1], '') AS decision FROM b""")
def html_statement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements among the paragraphs of pages: three of four pages have one, ended by a roster, a footer or the page; and its decision."""
    at, html, lit = F.col("page_id"), F.coalesce("html", F.lit("")), F.lit
    end = F.when(at % 4 == 1, ROSTER[0]).when(at % 4 == 2, ROSTER[1]).otherwise("")
    page = F.concat(lit(STATED[0]), at.cast("string"), lit(STATED[1]), html, lit(STATED[2]), at.cast("string"), lit(STATED[3]), end, html)
    s = M.statement(V.table(spark, sf_dir, "pages").select("page_id", F.when(at % 4 == 0, html).otherwise(page).alias("html")), "html")
    return s.select("page_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.length("statement").cast("long").alias("n_chars"), F.md5("statement").alias("statement_md5"), "decision")


@query("""WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, '') || ' Total revenues increased 5 percent due to ' || source || '. total Revenues increased 5 percent due to ' || source || '. Net sales declined.', '(?i)(?:net sales|total net sales|total revenues?|revenues?|total revenue)\\b[^.]{0,40}?(?:increased|decreased|grew|rose|declined)\\b[^.]*?(?:due to|driven by|primarily|reflect|as a result|attributable to)[^.]*\\.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS s FROM documents),
f AS (SELECT doc_id, list_filter(s, lambda x, i: len(x) > 30 AND len(x) < 320 AND list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i)[1:4] AS s FROM s) SELECT doc_id, array_to_string(s, ' ') AS drivers FROM f""")
def mda_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four sentences that say what drove revenue."""
    more = F.concat("text", F.lit(" Total revenues increased 5 percent due to "), "source", F.lit(". total Revenues increased 5 percent due to "), "source", F.lit(". Net sales declined."))
    return documents(spark, sf_dir).select("doc_id", L.drivers(more).alias("drivers"))




def sevenths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with an odd share of each value, so that no tie is rounded to two places."""
    return items(spark, sf_dir).withColumn("history", F.transform("history", lambda v: v * 0.137931))


FIGURES = "(SELECT series_id, dataset, origin, history, round(history[1] * 0.137931, 2) AS a, round(history[10] * 0.137931, 2) AS z, round(list_min(history) * 0.137931, 2) AS lo, round(list_max(history) * 0.137931, 2) AS hi, round(history[10] * 0.137931 - history[1] * 0.137931, 2) AS change FROM v_item)"


@query(f"{ITEM} SELECT series_id, a, z, lo, hi, change FROM {FIGURES}")
def facts_edgar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of facts of each channel: start, end, least, most, net change to two places."""
    i = sevenths(spark, sf_dir).withColumn("f", M.figures(F.col("history")))
    return i.select("series_id", "f.a", "f.z", "f.lo", "f.hi", "f.change")


def _described(template: str, gate: str) -> str:
    """SQL of a description: the cached candidate where its numbers are grounded, else the template."""
    return f"{ITEM}, f AS {FIGURES}, c AS (SELECT *, CASE WHEN day(origin) % 2 = 0 THEN 'It went from ' || a || ' to ' || z || '.' WHEN day(origin) % 3 = 0 THEN 'It reached 1.5 at once.' END AS candidate FROM f) SELECT series_id, md5(CASE WHEN day(origin) % 2 = 0 THEN candidate ELSE {template} END) AS text_md5, CASE WHEN day(origin) % 2 = 0 THEN 'derived_generated' ELSE {gate} END AS tag FROM c"


def _describe(spark: SparkSession, sf_dir: str, template, tag: str, rel: float = 0.0) -> DataFrame:
    i = sevenths(spark, sf_dir).withColumn("f", M.figures(F.col("history")))
    text = lambda c: F.col(f"f.{c}").cast("string")
    day = F.dayofmonth("origin")
    candidate = F.when(day % 2 == 0, F.concat(F.lit("It went from "), text("a"), F.lit(" to "), text("z"), F.lit("."))).when(day % 3 == 0, "It reached 1.5 at once.")
    out = M.grounded(i.withColumn("candidate", candidate).withColumn("template", template(text)), F.col("history"), rel, tag)
    return out.select("series_id", F.md5("text").alias("text_md5"), "tag")


@query(_described("dataset || ' stays.'", "'real'"))
def describe_fomc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached description if its numbers are the series', else the decision itself."""
    return _describe(spark, sf_dir, lambda t: F.concat("dataset", F.lit(" stays.")), "real")


@query(_described("'revenue went from $' || a || 'B (' || year(origin) || ') to $' || z || 'B.'", "'derived_template'"))
def describe_edgar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _describe(spark, sf_dir, lambda t: F.concat(F.lit("revenue went from $"), t("a"), F.lit("B ("), F.year("origin").cast("string"), F.lit(") to $"), t("z"), F.lit("B.")), "derived_template")


@query(_described("'rose from ' || a || '% to ' || z || '%, peaking at ' || hi || '%'", "'derived_template'"))
def describe_cyber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _describe(spark, sf_dir, lambda t: F.concat(F.lit("rose from "), t("a"), F.lit("% to "), t("z"), F.lit("%, peaking at "), t("hi"), F.lit("%")), "derived_template")


@query(_described("'began at ' || a || ', peaked at ' || hi || ', and decayed to ' || z || ' by day 9'", "'derived_template'"))
def describe_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _describe(spark, sf_dir, lambda t: F.concat(F.lit("began at "), t("a"), F.lit(", peaked at "), t("hi"), F.lit(", and decayed to "), t("z"), F.lit(" by day 9")), "derived_template")


@query(_described("'peaked at about ' || hi || 'k on point ' || (list_position(history, list_max(history)) - 1) || ', from ' || a || 'k to ' || z || 'k'", "'derived_template'"))
def describe_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers may be off by a hundredth; the peak is the first of the largest."""
    peak = (F.array_position("history", F.array_max("history")) - 1).cast("string")
    return _describe(spark, sf_dir, lambda t: F.concat(F.lit("peaked at about "), t("hi"), F.lit("k on point "), peak, F.lit(", from "), t("a"), F.lit("k to "), t("z"), F.lit("k")), "derived_template", 0.01)


@query("SELECT p_partkey AS id, p_brand || ': ' || CASE WHEN p_name = '' THEN p_type ELSE p_type || ' — ' || p_name END || '. ' || p_type AS text FROM part")
def text_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), M.cve_text(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_type")).alias("text"))


@query("SELECT c_custkey AS id, c_name || '. The magnitude ' || (c_custkey % 9) || ' earthquake struck near ' || c_mktsegment || ' on 2020-01-01 at ' || c_nationkey || ' km depth.' || CASE WHEN c_custkey % 3 = 0 THEN ' A tsunami was observed or warned.' ELSE '' END AS text FROM customer")
def text_mainshock(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    s = lambda x: x.cast("string")
    text = M.mainshock_text(F.col("c_name"), s(F.col("c_custkey") % 9), F.col("c_mktsegment"), F.lit("2020-01-01"), s(F.col("c_nationkey")), F.col("c_custkey") % 3 == 0)
    return c.select(F.col("c_custkey").alias("id"), text.alias("text"))


@query("SELECT doc_id, source AS title, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS lead_md5 FROM documents")
def wiki_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("lead_md5"))


# emission ladders


LADDER = f"""{ITEM}, p AS (SELECT series_id, dt, idx, price, count(*) OVER (PARTITION BY series_id) AS n FROM v_price), r AS (SELECT day, max(article_id) AS article_id FROM v_article GROUP BY 1),
e AS (SELECT p.*, r.day AS rev FROM p ASOF LEFT JOIN r ON p.dt > r.day)"""


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point of a series as a possible spike, with the day of the latest article before it."""
    from ..operators.retrieve import asof_backward

    p = V.price(spark, sf_dir)
    n = p.groupBy("series_id").agg(F.count("*").alias("n"))  # a row for each series
    days = V.article(spark, sf_dir).select("day").distinct()
    got = asof_backward(p.withColumn("day", F.col("dt")), days, "day", [], ["day"], True).join(n, "series_id")
    return got.select("series_id", "dt", "idx", "price", "n", F.col("right_day").alias("rev"))


@query(f"{LADDER} SELECT series_id, dt, CASE WHEN idx % 5 = 0 THEN 'meta_incomplete' WHEN n < 60 THEN 'no_pageviews' WHEN rev IS NULL THEN 'no_prior_revision' WHEN rev >= dt THEN 'revision_not_before_spike' WHEN idx < 30 OR n - idx < 14 THEN 'insufficient_history_or_horizon' ELSE 'emitted' END AS reason FROM e")
def wiki_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spikes(spark, sf_dir)
    reason = M.wiki_reason(F.col("idx") % 5 != 0, F.col("n"), F.lit(None).cast("string"), F.col("rev"), F.col("dt"), F.col("idx"), F.col("n") - F.col("idx"), 30, 14)
    return s.select("series_id", "dt", reason.alias("reason"))


@query(f"{LADDER} SELECT series_id, count(*) AS spikes, count(*) FILTER (WHERE idx >= 8 AND idx + 6 <= n AND rev IS NOT NULL AND rev < dt) AS emitted, round(sum(least(idx, 21)) FILTER (WHERE idx >= 8 AND idx + 6 <= n AND rev IS NOT NULL), 0)::BIGINT AS history_points, sum(least(n - idx, 14)) FILTER (WHERE idx >= 8 AND idx + 6 <= n AND rev IS NOT NULL)::BIGINT AS future_points FROM e GROUP BY 1")
def wiki_multi_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spike with eight points before it and six from it on; up to 21 before and 14 from it go out."""
    s = spikes(spark, sf_dir)
    fits = (F.col("idx") >= 8) & (F.col("idx") + 6 <= F.col("n")) & F.col("rev").isNotNull() & (F.col("rev") < F.col("dt"))
    return s.groupBy("series_id").agg(F.count("*").alias("spikes"), F.count_if(fits).alias("emitted"), F.sum(F.when(fits, F.least("idx", F.lit(21)))).alias("history_points"), F.sum(F.when(fits, F.least(F.col("n") - F.col("idx"), F.lit(14)))).alias("future_points"))


@query(f"{LADDER}, t AS (SELECT DISTINCT series_id FROM e WHERE idx >= 30 AND n - idx >= 14 AND rev IS NOT NULL AND idx % 5 <> 0) SELECT series_id, count(*) AS n FROM e WHERE series_id IN (SELECT series_id FROM t) GROUP BY 1")
def wiki_persistent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the run of single peaks has emitted."""
    s = spikes(spark, sf_dir)
    trace = wiki_emit(spark, sf_dir).where("reason = 'emitted'").select("series_id").distinct()
    return s.join(trace, "series_id", "left_semi").groupBy("series_id").agg(F.count("*").alias("n"))


@query(f"WITH {V.VIEWS}, x AS (SELECT *, max(hour) OVER (PARTITION BY entity) AS last FROM v_views) SELECT entity, count(*) AS n, round(sum(v), 2) AS views FROM x WHERE hour >= last - INTERVAL 730 DAY - INTERVAL 120 DAY AND hour <= last - INTERVAL 0 DAY GROUP BY 1")
def wiki_long_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points from 730 days before to 120 days after a seed, here 120 days before the last point."""
    v = V.views(spark, sf_dir)
    seed = v.groupBy("entity").agg((F.max("hour") - F.expr("INTERVAL 120 DAY")).alias("seed"))
    return M.long_window(v.join(seed, "entity"), F.col("hour"), F.col("seed")).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("views"))


OIL = f"""{LADDER}, m AS (SELECT e.series_id, e.idx, count(*) FILTER (WHERE a.day < e.dt) AS kept, count(*) FILTER (WHERE a.day >= e.dt) AS dropped FROM e JOIN v_article a ON a.day BETWEEN e.dt - 4 AND e.dt + 2 GROUP BY ALL)"""


@query(f"{OIL} SELECT e.series_id, e.dt, coalesce(dropped, 0) AS dropped_for_leakage, CASE WHEN coalesce(kept, 0) = 0 THEN 'no_retrieval' WHEN e.idx < 10 OR e.idx + 5 > n THEN 'series_boundary' WHEN e.idx % 4 = 0 THEN 'no_verified_cause' ELSE 'emitted' END AS reason FROM e LEFT JOIN m ON e.series_id = m.series_id AND e.idx = m.idx")
def oil_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spikes(spark, sf_dir)
    at = s.select("series_id", "idx", "dt", F.explode(F.sequence(F.date_sub("dt", 4), F.date_add("dt", 2))).alias("day"))
    daily = V.article(spark, sf_dir).groupBy("day").agg(F.count("*").alias("articles"))
    m = at.join(daily, "day").groupBy("series_id", "idx").agg(F.sum(F.when(F.col("day") < F.col("dt"), F.col("articles")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("day") >= F.col("dt"), F.col("articles")).otherwise(0)).alias("dropped"))
    j = s.join(m, ["series_id", "idx"], "left")
    reason = M.oil_reason(F.coalesce("kept", F.lit(0)), F.col("idx"), F.col("n"), F.col("idx") % 4 != 0, 10, 5)
    return j.select("series_id", "dt", F.coalesce("dropped", F.lit(0)).alias("dropped_for_leakage"), reason.alias("reason"))


@query(f"{ITEM}, h AS (SELECT DISTINCT day FROM v_article) SELECT series_id, dt FROM v_price WHERE dt NOT IN (SELECT day FROM h)")
def oil_retrieval_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that the cache has nothing for."""
    have = V.article(spark, sf_dir).select(F.col("day").alias("dt")).distinct()
    return V.price(spark, sf_dir).select("series_id", "dt").join(have, "dt", "left_anti").select("series_id", "dt")


QUERIES, ORACLES = query.queries, query.oracles
