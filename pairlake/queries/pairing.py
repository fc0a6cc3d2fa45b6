"""Pair building over price windows and articles: normalising, records, conversions, small scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import pairs as P
from ..operators import retrieve as R
from ..plans import views as V
from .common import Registry, r6

query = Registry()
ITEM = f"WITH {V.ITEM}"
NORM = ITEM + """, v_dev AS (SELECT *, list_avg(history) AS m FROM v_item), v_sd AS (SELECT *, sqrt(list_avg(list_transform(history, lambda x: pow(x - m, 2)))) AS sd FROM v_dev),
v_norm AS (SELECT *, greatest(sd, 1e-3 * greatest(abs(m), 1)) AS std FROM v_sd)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.item(spark, sf_dir)


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("m", S.mean(F.col("history"))).withColumn("sd", S.std(F.col("history")))
    return rows.withColumn("std", S.std_floor(F.col("m"), F.col("sd")))


@query(f"{NORM} SELECT series_id, round(m, 5) AS mean, round(std, 5) AS std, std > sd AS floored, round((history[1] - m) / std, 5) AS first_z FROM v_norm")
def zscore_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _normed(spark, sf_dir)
    return n.select("series_id", F.round("m", 5).alias("mean"), F.round("std", 5).alias("std"), (F.col("std") > F.col("sd")).alias("floored"), F.round((F.col("history")[0] - F.col("m")) / F.col("std"), 5).alias("first_z"))


@query(f"{NORM} SELECT series_id, round(list_avg(list_transform(list_concat(history, future), lambda x: (x - m) / std)), 5) AS mean_z FROM v_norm")
def zscore_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.transform(F.concat("history", "future"), lambda x: (x - F.col("m")) / F.col("std"))
    return _normed(spark, sf_dir).select("series_id", F.round(S.mean(z), 5).alias("mean_z"))


@query(f"{NORM} SELECT series_id, round((future[1] - m) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 5) AS z FROM v_norm")
def znorm_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return _normed(spark, sf_dir).select("series_id", F.round((F.col("future")[0] - F.col("m")) / sd, 5).alias("z"))


@query(f"{NORM} SELECT series_id, round(list_sum(history), 3) AS total FROM v_norm")
def denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.transform("history", lambda x: (x - F.col("m")) / F.col("std"))
    return _normed(spark, sf_dir).select("series_id", F.round(S.total(P.denormalised(z, F.col("m"), F.col("std"))), 3).alias("total"))


REC = f"{ITEM}, v_rec AS (SELECT *, '<|im_start|>user' || chr(10) || text || chr(10) || '(history=<ts></ts>)<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<ts></ts><|im_end|>' || chr(10) AS rec FROM v_item)"


@query(f"{REC} SELECT series_id, len(history) AS h, len(history) + len(future) AS target_len, len(rec) AS n_chars, md5(rec) AS text_md5 FROM v_rec")
def build_ts_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.forecast_record(items(spark, sf_dir))
    t = F.col("timeseries")
    return r.select("series_id", t[0]["len"].cast("long").alias("h"), t[1]["len"].cast("long").alias("target_len"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"{ITEM} SELECT series_id, len('<|im_start|>user' || chr(10) || 'Describe the series. <ts></ts><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS a, len(text) AS n FROM v_item")
def build_text_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.description_record(items(spark, sf_dir)).select("series_id", F.col("ranges")[0].alias("r"))
    return r.select("series_id", F.col("r")[0].cast("long").alias("a"), (F.col("r")[1] - F.col("r")[0]).cast("long").alias("n"))


@query(f"{ITEM} SELECT series_id, text AS description FROM v_item")
def chatml_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.description_record(items(spark, sf_dir)).select("series_id", P.description(F.col("text"), F.col("ranges")).alias("description"))


@query(f"{ITEM} SELECT series_id, text AS cond FROM v_item")
def cond_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.forecast_record(items(spark, sf_dir))
    return r.select("series_id", P.before_any(P.turn(F.col("text"), P.USER), P.CUTS[:1]).alias("cond"))


@query(f"{ITEM} SELECT series_id, text AS cause FROM v_item")
def cause_text_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forecast_record(items(spark, sf_dir)).select("series_id", P.before_any(P.turn(F.col("text"), P.USER)).alias("cause"))


@query(f"{ITEM} SELECT series_id, text || chr(10) || '(history=<ts></ts>)' AS turn FROM v_item")
def user_text_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forecast_record(items(spark, sf_dir)).select("series_id", P.turn(F.col("text"), P.USER).alias("turn"))


@query(f"{ITEM} SELECT series_id, md5(rtrim(text, '. ') || '. <ts></ts>') AS text_md5, '1d' AS freq, 'real' AS text_quality FROM v_item WHERE len(text) > 0")
def emit_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).where(F.length("text") > 0)
    return i.select("series_id", F.md5(P.pretraining_text(F.col("text"), F.lit(1))).alias("text_md5"), F.lit(P.FREQUENCIES["daily"]).alias("freq"), F.lit("real").alias("text_quality"))


@query(f"{ITEM} SELECT series_id, round(list_sum(history), 3) AS total, 1 AS tokens FROM v_item WHERE len(text) >= 10")
def chatml_to_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.description_record(items(spark, sf_dir)).withColumn("d", P.description(F.col("text"), F.col("ranges"))).where(F.length("d") >= 10)
    raw = P.denormalised(F.col("timeseries")[0]["values"], F.col("mean"), F.col("std"))
    # six places of z carry an error of std / 1e6 a value; the sum is compared at the original numbers' three places
    exact = items(spark, sf_dir).select(F.col("series_id").alias("k"), S.total(F.col("history")).alias("t"))
    near = r.select("series_id", S.total(raw).alias("s"), "std").join(exact, F.col("series_id") == F.col("k"))
    return near.where(F.abs(F.col("s") - F.col("t")) <= 1e-5 * F.col("std") + 1e-6).select("series_id", F.round("t", 3).alias("total"), F.lit(1).alias("tokens"))


@query(f"{ITEM} SELECT series_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' <ts></ts> .', '\\s*<ts></ts>\\s*', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g'), '\\.{{2,}}', '.', 'g'), '\\s{{2,}}', ' ', 'g')), '$', '') AS answer FROM v_item WHERE NOT regexp_matches(text, '[,;:][.,;:]')")
def clean_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).where(~F.col("text").rlike("[,;:][.,;:]"))
    return i.select("series_id", P.clean_answer(F.concat("text", F.lit(" <ts></ts> ."))).alias("answer"))


@query("SELECT p_partkey AS id, coalesce(nullif(regexp_replace(regexp_replace('2019 ' || p_name || ' Earthquake', '^\\d{4}\\s+', ''), '(?i)\\s*earthquake$', ''), ''), p_name) AS place FROM part")
def place_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), P.place(F.concat(F.lit("2019 "), "p_name", F.lit(" Earthquake"))).alias("place"))


@query("SELECT p_partkey AS id, CASE WHEN starts_with(lower(p_name), lower(split_part(p_name, ' ', 1))) THEN p_name ELSE split_part(p_name, ' ', 1) || ' ' || p_name END AS vp, CASE WHEN starts_with(lower(p_type), lower(p_brand)) THEN p_type ELSE p_brand || ' ' || p_type END AS bt FROM part")
def vendor_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda v, p: F.when(F.startswith(F.lower(p), F.lower(v)), p).otherwise(F.concat(v, F.lit(" "), p))
    p = V.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), join(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_name")).alias("vp"), join(F.col("p_brand"), F.col("p_type")).alias("bt"))


SNAP = f"WITH {V.PRICE}, a AS (SELECT DISTINCT series_id, (dt + 1)::DATE AS want FROM v_price), s AS (SELECT a.series_id, a.want, p.idx AS pos FROM a ASOF JOIN v_price p ON a.series_id = p.series_id AND a.want >= p.dt)"


def _snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.price(spark, sf_dir)
    want = p.select("series_id", F.date_add("dt", 1).alias("dt")).distinct()
    return R.asof_backward(want, p, "dt", ["series_id"], ["dt", "idx"], False).select("series_id", F.col("dt").alias("want"), F.col("right_idx").alias("pos"))


@query(f"{SNAP} SELECT s.series_id, want, pos, count(*) AS n, round(sum(price) / 7.0, 4) AS total FROM s JOIN v_price p ON p.series_id = s.series_id AND p.idx BETWEEN pos - 5 AND pos + 5 GROUP BY ALL")
def snap_le_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = _snap(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.col("pos") - 5, F.col("pos") + 5)))
    p = V.price(spark, sf_dir).select(F.col("series_id").alias("s"), F.col("idx"), "price")
    j = around.join(p, (F.col("series_id") == F.col("s")) & (F.col("i") == F.col("idx")))
    return j.groupBy("series_id", "want", "pos").agg(F.count("*").alias("n"), F.round(F.sum("price") / 7.0, 4).alias("total"))


@query(f"{SNAP}, g AS (SELECT s.series_id, want, count(*) FILTER (WHERE idx <= pos) AS h, count(*) FILTER (WHERE idx > pos) AS f FROM s JOIN v_price p ON p.series_id = s.series_id AND p.idx BETWEEN pos - 7 AND pos + 3 GROUP BY ALL) SELECT * FROM g WHERE h >= 3 AND f >= 1")
def snap_le_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = _snap(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.col("pos") - 7, F.col("pos") + 3)))
    p = V.price(spark, sf_dir).select(F.col("series_id").alias("s"), F.col("idx"))
    g = around.join(p, (F.col("series_id") == F.col("s")) & (F.col("i") == F.col("idx"))).groupBy("series_id", "want").agg(F.count_if(F.col("idx") <= F.col("pos")).alias("h"), F.count_if(F.col("idx") > F.col("pos")).alias("f"))
    return g.where("h >= 3 and f >= 1")


@query(f"{ITEM} SELECT series_id, round(list_sum(history[6:]) / 7.0, 4) AS h, round(list_sum(future[:3]) / 7.0, 4) AS f FROM v_item")
def fix_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("series_id", F.round(S.total(F.slice("history", -5, 5)) / 7.0, 4).alias("h"), F.round(S.total(F.slice("future", 1, 3)) / 7.0, 4).alias("f"))


@query(f"{ITEM} SELECT series_id, len(history) AS h, len(future) AS f, round(list_sum(future), 3) AS total FROM v_item")
def spans_hist_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select("series_id", F.size("history").cast("long").alias("h"), F.size("future").cast("long").alias("f"), F.round(S.total(F.col("future")), 3).alias("total"))


@query(f"{ITEM} SELECT series_id, CASE WHEN len(text) > 40 THEN text ELSE '' END AS fact, dataset AS preds FROM v_item")
def summaries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("series_id", F.when(F.length("text") > 40, F.col("text")).otherwise("").alias("fact"), F.col("dataset").alias("preds"))


CYCLE = f"WITH {V.PRICE}, a AS (SELECT *, [5, 7, 10, 14][(idx % 4 + 1)::INT] AS c FROM v_price)"


@query(f"{CYCLE} SELECT a.series_id, a.idx, greatest(4, least(c, 12))::INT AS h, max(p.price) - min(p.price) < 0.5 AS flat FROM a JOIN v_price p ON a.series_id = p.series_id AND p.idx > a.idx - greatest(4, least(c, 12)) AND p.idx <= a.idx GROUP BY ALL")
def adapt_cyber(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.price(spark, sf_dir)
    c = F.element_at(F.array(*(F.lit(x) for x in (5, 7, 10, 14))), (F.col("idx") % 4 + 1).cast("int"))
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-13, 0)
    r = p.withColumn("all", F.collect_list("price").over(w)).withColumn("h", F.greatest(F.lit(4), F.least(c, F.lit(12))))
    n = F.least("h", F.size("all"))  # early points have fewer before them
    own = F.slice("all", -n, n)
    return r.select("series_id", "idx", "h", (F.array_max(own) - F.array_min(own) < 0.5).alias("flat"))


@query(f"WITH {V.PRICE}, a AS (SELECT *, [20, 30, 45, 60][(row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1) % 4 + 1] AS h FROM v_price) SELECT a.series_id, a.idx, h::INT AS h, count(*) AS n FROM a JOIN v_price p ON a.series_id = p.series_id AND p.idx > a.idx - h AND p.idx <= a.idx GROUP BY ALL")
def adapt_fomc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.price(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("idx")
    cycle = F.element_at(F.array(*(F.lit(x) for x in (20, 30, 45, 60))), (F.row_number().over(w) - 1) % 4 + 1)
    return p.withColumn("h", cycle).select("series_id", "idx", "h", F.least("h", F.col("idx") + 1).cast("long").alias("n"))


QUAKE = "WITH q AS (SELECT c_custkey AS id, list(o_totalprice ORDER BY o_orderkey) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def _quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    return g.select("id", F.transform("a", lambda x: x["o_totalprice"]).alias("s"))


@query(f"{QUAKE} SELECT id, len(s) >= 8 AS t2s, round(list_sum(s[1:5]), 2) AS head, len(s[6:]) AS tail FROM q WHERE len(s) >= 6")
def adapt_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quakes(spark, sf_dir).where(F.size("s") >= 6)
    return q.select("id", (F.size("s") >= 8).alias("t2s"), F.round(S.total(F.slice("s", 1, 5)), 2).alias("head"), (F.size("s") - 5).cast("long").alias("tail"))


@query(f"{QUAKE} SELECT id, len(s) AS n FROM q WHERE len(s) >= 5")
def adapt_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quakes(spark, sf_dir).where(F.size("s") >= 5).select("id", F.size("s").cast("long").alias("n"))


@query("WITH y AS (SELECT o_custkey AS id, year(o_orderdate) AS fy, round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS v FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fy DESC) AS k FROM y) SELECT id, count(*) AS n, min(fy)::INT AS first_fy FROM r WHERE k <= 7 GROUP BY 1 HAVING count(*) >= 3")
def adapt_edgar(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("fy")).agg(F.sum("o_totalprice").alias("v"))
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("fy")))
    return y.withColumn("k", k).where("k <= 7").groupBy("id").agg(F.count("*").alias("n"), F.min("fy").alias("first_fy")).where("n >= 3")


@query("SELECT o_custkey AS id, year(o_orderdate)::INT AS fy, max_by(round(o_totalprice / 1e3, 3), o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' AND day(o_orderdate) BETWEEN 5 AND 25 GROUP BY ALL")
def scan_xbrl_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.dayofmonth("o_orderdate").between(5, 25))
    return o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("fy")).agg(F.max_by(F.round(F.col("o_totalprice") / 1e3, 3), "o_orderkey").alias("v"))


@query("WITH g AS (SELECT o_custkey AS id, o_orderpriority AS tag, count(DISTINCT year(o_orderdate)) AS n, max(year(o_orderdate)) AS y FROM orders GROUP BY ALL HAVING count(DISTINCT year(o_orderdate)) >= 2) SELECT id, tag, n, y::INT AS y FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, y DESC, tag) = 1")
def xbrl_best_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag")).agg(F.countDistinct(F.year("o_orderdate")).alias("n"), F.max(F.year("o_orderdate")).alias("y")).where("n >= 2")
    return g.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("y"), "tag"))).where("k = 1").drop("k")


@query(f"WITH {V.VIEWS} SELECT entity, strftime(hour, '%Y%m%d') AS day, round(sum(v) / 1000, 3) AS views FROM v_views GROUP BY ALL")
def scan_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.views(spark, sf_dir).groupBy("entity", F.date_format("hour", "yyyyMMdd").alias("day")).agg(F.round(F.sum("v") / 1000, 3).alias("views"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations")
    one = F.struct("turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit(P.END + "\n")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda t: t["x"]), "").alias("text"))


@query("SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS plain FROM pages")
def html_to_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", P.plain(F.col("html")).alias("plain"))


@query("WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents), w AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_split_to_array(trim(x), '\\s+'))) AS w FROM s) SELECT doc_id, array_to_string(list_filter(s, lambda x, i: list_sum(w[1:i]) <= 40), ' ') AS lead FROM w")
def extractive_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", P.compressed(F.split("text", r"(?<=[.!?])\s+"), 40).alias("lead"))


@query(f"{QUAKE} SELECT id, len(s) AS n, array_to_string(list_transform(s, lambda v: ['▁', '▂', '▃', '▄', '▅', '▆', '▇', '█'][floor((v - list_min(s)) / CASE WHEN list_max(s) = list_min(s) THEN 1.0::DOUBLE ELSE list_max(s) - list_min(s) END * 7.999::DOUBLE)::INT + 1]), '') AS line FROM q")
def sink_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quakes(spark, sf_dir).select("id", F.size("s").cast("long").alias("n"), S.sparkline(F.col("s")).alias("line"))


@query(f"{ITEM} SELECT series_id, origin, kt, 'pair@1' AS schema_version, 'text_to_ts' AS kind, kt IS NOT NULL AS has_kt FROM v_item")
def emit_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a JSON record and back: nothing is lost."""
    i = items(spark, sf_dir)
    payload = F.struct("series_id", "origin", "kt", "history", "future", "text")
    shape = i.select(payload.alias("p")).schema["p"].dataType
    back = i.select("series_id", payload.alias("p"), F.to_json(F.struct(F.lit("pair@1").alias("schema_version"), F.lit("text_to_ts").alias("kind"), payload.alias("payload"))).alias("ir"))
    whole = "struct<schema_version:string,kind:string,payload:" + shape.simpleString() + ">"
    back = back.withColumn("r", F.from_json("ir", whole)).where(F.col("r.payload").eqNullSafe(F.col("p")))
    return back.select("series_id", F.col("r.payload.origin").alias("origin"), F.col("r.payload.kt").alias("kt"), F.col("r.schema_version").alias("schema_version"), F.col("r.kind").alias("kind"), F.col("r.payload.kt").isNotNull().alias("has_kt"))


@query("SELECT source, count(*) AS n FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE len(text) > 20) WHERE r <= 400 GROUP BY 1")
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").where(F.length("text") > 20)
    return R.first_of(d, ["source"], "doc_id", 400).select("source", F.size("first").cast("long").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
