"""Text gates over the whole texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..operators import retrieve as R
from ..plans import views as V
from .common import Registry

query = Registry()
SQ = lambda p: p.replace("'", "''")
NOUNS = ("prices", "crude", "shares", "yields")
X = f"WITH {V.TEXT}"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.text(spark, sf_dir)


@query(f"{X} SELECT id, regexp_matches(txt, '{SQ(L.PRICE_PROJECTION)}') AS leak FROM v_text")
def forecast_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", L.has(F.col("txt"), L.PRICE_PROJECTION).alias("leak"))


@query(f"{X} SELECT id, regexp_matches(txt, '{SQ(L.DIRECTION)}') AS leak FROM v_text")
def direction_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", L.has(F.col("txt"), L.DIRECTION).alias("leak"))


@query(f"{X} SELECT id, coalesce(len(list_filter(regexp_extract_all(txt, '\\b(20\\d{{2}})\\b', 1), lambda y: y::INT > try_cast(regexp_extract(event_date, '^(\\d{{4}})', 1) AS INT))) > 0, false) AS leak FROM v_text")
def future_year_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", L.future_year(F.col("txt"), F.col("event_date")).alias("leak"))


@query(f"{X} SELECT id, regexp_matches(txt, '{SQ(L.outcome(NOUNS))}') AS leak FROM v_text")
def outcome_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", L.has(F.col("txt"), L.outcome(NOUNS)).alias("leak"))


@query(f"{X} SELECT id, k AS commodity, regexp_matches(txt, pat) AS leak FROM v_text CROSS JOIN (VALUES ('gas', '{SQ(L.outcome(['gas prices', 'gas']))}'), ('oil', '{SQ(L.outcome(['crude', 'oil prices']))}')) c(k, pat)")
def outcome_leak_by_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(L.ALL_SCRIPTS + L.outcome(n)).alias("pat")) for k, n in {"gas": ["gas prices", "gas"], "oil": ["crude", "oil prices"]}.items()))
    return texts(spark, sf_dir).withColumn("c", F.explode(each)).select("id", F.col("c.k").alias("commodity"), F.expr("txt RLIKE c.pat").alias("leak"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(txt, '{SQ(p)}'))"


MONTH = "list_extract(['january','february','march','april','may','june','july','august','september','october','november','december'], nullif(regexp_extract(event_date, '^\\d{4}-(0[1-9]|1[0-2])', 1), '')::INT)"
SCORE = f"""{X}, a AS (SELECT id, event_date, {_count(L.EVENTIVE)} AS ev, {_count(L.STATIVE)} AS st, regexp_matches(txt, '{SQ(L.RECENCY)}') AS rec,
  coalesce(contains(lower(txt), {MONTH}), false) AS mon, regexp_matches(txt, '{SQ(L.BORN)}') OR regexp_matches(txt, '{SQ(L.KIND)}') AS bio FROM v_text),
s AS (SELECT id, ev::INT AS n_eventive, st::INT AS n_stative, greatest(0, least(100, 50 * (ev >= 1)::INT + 20 * (ev >= 2)::INT + 20 * rec::INT + 15 * mon::INT - 55 * bio::INT - 6 * greatest(0, st - 1))) / 100.0::DOUBLE AS score,
  CASE WHEN (bio OR (st >= 2 AND ev = 0)) AND NOT (ev >= 1 OR rec OR mon) THEN 'weak' ELSE 'coupled' END AS label FROM a)"""


@query(f"{SCORE} SELECT * FROM s")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.score(F.col("txt"), F.col("event_date"))
    return texts(spark, sf_dir).select("id", *(c.alias(k) for k, c in s.items()))


@query(f"{SCORE} SELECT coalesce((id % 3)::VARCHAR, 'TOTAL') AS file, count(*) FILTER (WHERE label = 'coupled') AS coupled, count(*) FILTER (WHERE label = 'weak') AS weak, median(score) AS median FROM s GROUP BY ROLLUP (id % 3)")
def audit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = match_score(spark, sf_dir).withColumn("file", (F.col("id") % 3).cast("string"))
    out = s.rollup("file").agg(F.count_if(F.col("label") == "coupled").alias("coupled"), F.count_if(F.col("label") == "weak").alias("weak"), F.median("score").alias("median"))
    return out.withColumn("file", F.coalesce("file", F.lit("TOTAL")))


@query(f"{X} SELECT id, round(list_aggregate(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), 'sum'), 4) AS total, len(regexp_extract_all(txt, '\\d+\\.\\d+')) AS n FROM v_text")
def decimals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.decimals(F.col("txt"))
    return texts(spark, sf_dir).select("id", F.round(F.when(F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda a, x: a + x)), 4).alias("total"), F.size(d).cast("long").alias("n"))


@query(f"{X} SELECT id, array_to_string(list_filter(regexp_extract_all(txt, '[\\d.,/-]+'), lambda x: regexp_full_match(x, '\\d+')), ',') AS integers FROM v_text")
def integers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.all_of(F.col("txt"), r"(?<![\d.,/-])\d+(?![\d.,/-])")
    return texts(spark, sf_dir).select("id", F.array_join(found, ",").alias("integers"))


@query(f"""{X}, n AS (SELECT id, list_distinct(list_filter(list_transform(regexp_extract_all(txt, '-?\\d[\\d,]*\\.?\\d*'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)) AS v FROM v_text)
SELECT id, len(v) AS n, list_min(v) AS least, list_max(v) AS most FROM n""")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.numbers(F.col("txt"))
    return texts(spark, sf_dir).select("id", F.size(v).cast("long").alias("n"), F.array_min(v).alias("least"), F.array_max(v).alias("most"))


FRACTION = "split_part(m, '/', 1)::DOUBLE / split_part(m, '/', 2)::DOUBLE"


@query(f"""{X}, f AS (SELECT id, translate(txt, '‐‑‒–—', '-----') AS t FROM v_text), r AS (SELECT id, t, regexp_replace(t, '\\d+-\\d+/\\d+', ' ', 'g') AS r1 FROM f), q AS (SELECT *, regexp_replace(r1, '\\d+/\\d+', ' ', 'g') AS r2 FROM r),
v AS (SELECT id, list_concat(list_transform(regexp_extract_all(t, '\\d+-\\d+/\\d+'), lambda m: split_part(m, '-', 1)::DOUBLE + split_part(split_part(m, '-', 2), '/', 1)::DOUBLE / nullif(split_part(m, '/', 2)::DOUBLE, 0)),
  list_transform(regexp_extract_all(r1, '\\d+/\\d+'), lambda m: split_part(m, '/', 1)::DOUBLE / nullif(split_part(m, '/', 2)::DOUBLE, 0)), list_transform(regexp_extract_all(r2, '(\\d+)\\s+(?:percent|to)\\b', 1), lambda m: m::DOUBLE)) AS v FROM q),
d AS (SELECT id, list_distinct(list_filter(list_transform(v, lambda x: round(x, 2)), lambda x: x IS NOT NULL)) AS v FROM v) SELECT id, len(v) AS n, list_min(v) AS least, list_max(v) AS most FROM d""")
def policy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.policy_numbers(F.col("txt"))
    return texts(spark, sf_dir).select("id", F.size(v).cast("long").alias("n"), F.array_min(v).alias("least"), F.array_max(v).alias("most"))


@query(f"{X} SELECT id, len(list_filter(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda n: NOT (abs(n - 2.5) <= 0.025 OR abs(n - 3.19) <= 0.0319 OR abs(n - 5.24) <= 0.0524))) AS n_unmatched FROM v_text")
def unmatched_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.lit(2.5), F.lit(3.19), F.lit(5.24))
    return texts(spark, sf_dir).select("id", F.size(L.unmatched(L.decimals(F.col("txt")), allowed, 0.01)).cast("long").alias("n_unmatched"))


@query(f"{X} SELECT id, len(list_filter(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda n: abs(n - 2.5) > 0.025)) = 0 AS consistent FROM v_text")
def is_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", (F.size(L.unmatched(L.decimals(F.col("txt")), F.array(F.lit(2.5)), 0.01)) == 0).alias("consistent"))


GROUND = "Opec cuts output as russia and ukraine clash; IEA says stocks fell 3.2 percent, Brent up."


def _entities(c: str) -> str:
    """The entities of a text column: acronyms, names of several words, known words; the first of each in any case."""
    known = ", ".join(f"'{w}'" for w in L.KNOWN)
    found = f"list_concat(regexp_extract_all({c}, '{L.ACRONYM}'), regexp_extract_all({c}, '{L.MULTIWORD}'), list_filter(regexp_extract_all({c}, '{L.TITLE}'), lambda w: list_contains([{known}], lower(w))))"
    return f"list_transform({found}, lambda e: trim(regexp_replace(e, '^(?:The|A|An)\\s+', '')))"


def _forms(e: str) -> str:
    long = f"list_filter(regexp_split_to_array(lower({e}), '[ /-]+'), lambda t: len(t) >= 4)"
    acronym = f"CASE WHEN upper({e}) = {e} AND regexp_matches({e}, '[A-Z]') AND len({e}) >= 2 THEN [lower({e})] ELSE [] END"
    words = f"list_filter(regexp_split_to_array({e}, '[ -]+'), lambda w: regexp_matches(w, '^[A-Z]'))"
    initials = f"CASE WHEN len({words}) >= 2 THEN [lower(array_to_string(list_transform({words}, lambda w: substr(w, 1, 1)), ''))] ELSE [] END"
    return f"(CASE WHEN len({long}) + len({acronym}) + len({initials}) > 0 THEN list_concat({long}, {acronym}, {initials}) ELSE [lower({e})] END)"


ENTITIES = f"""{X}, v_raw AS (SELECT id, txt, raw, {_entities("txt")} AS r FROM v_text),
v_ent AS (SELECT id, txt, raw, list_filter(r, lambda x, i: x <> '' AND list_position(list_transform(r, lambda y: lower(y)), lower(x)) = i) AS e FROM v_raw),
v_form AS (SELECT id, u.pos, u.entity FROM v_ent, LATERAL (SELECT unnest(e) AS entity, generate_subscripts(e, 1) AS pos) u),
v_traced AS (SELECT *, {_forms("entity")} AS forms FROM v_form),
v_trace AS (SELECT id, pos, entity, forms, len(list_filter(forms, lambda f: contains(' ' || regexp_replace(lower('{GROUND}'), '[^a-z0-9]+', ' ', 'g'), ' ' || substr(f, 1, 6)))) > 0 AS traced FROM v_traced)"""


@query(f"{ENTITIES} SELECT id, array_to_string(e, '|') AS entities FROM v_ent")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.array_join(L.entities(F.col("txt")), "|").alias("entities"))


@query(f"{ENTITIES} SELECT id, entity, array_to_string(forms, '|') AS forms FROM v_trace")
def match_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.explode(L.entities(F.col("txt"))).alias("entity")).select("id", "entity", F.array_join(L.forms(F.col("entity")), "|").alias("forms"))


@query(f"{X} SELECT id, regexp_matches(split_part(txt, ' ', 1), '^[A-Z]{{2}}$') AS weak FROM v_text")
def is_weak_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", L.weak_entity(F.split_part("txt", F.lit(" "), F.lit(1))).alias("weak"))


@query(f"{ENTITIES} SELECT id, entity, traced FROM v_trace")
def trace_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = texts(spark, sf_dir).select("id", F.explode(L.entities(F.col("txt"))).alias("entity"))
    return e.select("id", "entity", L.traced(F.col("entity"), F.lit(GROUND)).alias("traced"))


def _faithful(rows: DataFrame) -> DataFrame:
    """id, verdict, coverage of txt against GROUND."""
    e = rows.withColumn("e", L.entities(F.col("txt")))
    e = e.withColumn("lost", F.filter("e", lambda x: ~L.traced(x, F.lit(GROUND))))
    bad = L.unmatched(L.decimals(F.col("txt")), L.decimals(F.lit(GROUND)))
    strong = F.exists("lost", lambda x: ~L.weak_entity(x))
    verdict = F.when(strong, "unsupported_entity").when(F.size(bad) > 0, "unsupported_number").otherwise("ok")
    cover = F.when(F.size("e") == 0, 1.0).otherwise(F.round((F.size("e") - F.size("lost")) / F.size("e"), 3))
    return e.select("id", verdict.alias("verdict"), cover.alias("coverage"))


FAITHFUL = f"""{ENTITIES}, v_lost AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE NOT traced) AS lost, count(*) FILTER (WHERE NOT traced AND NOT regexp_matches(entity, '^[A-Z]{{2}}$')) AS strong FROM v_trace GROUP BY 1),
v_faith AS (SELECT t.id, CASE WHEN coalesce(strong, 0) > 0 THEN 'unsupported_entity' WHEN len(list_filter(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda v: abs(v - 3.2) > 0.02)) > 0 THEN 'unsupported_number' ELSE 'ok' END AS verdict,
  CASE WHEN l.id IS NULL THEN 1.0 ELSE round((n - lost) / n, 3) END::DOUBLE AS coverage FROM v_text t LEFT JOIN v_lost l USING (id))"""


@query(f"{FAITHFUL} SELECT id, verdict, coverage FROM v_faith")
def faithfulness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faithful(texts(spark, sf_dir))


@query(f"{FAITHFUL} SELECT id, verdict = 'ok' AS faithful FROM v_faith")
def faithful_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faithful(texts(spark, sf_dir)).select("id", (F.col("verdict") == "ok").alias("faithful"))


@query(f"{FAITHFUL} SELECT verdict, count(*) AS n, bool_or(control) AS control_rejected FROM (SELECT verdict, false AS control FROM v_faith UNION ALL SELECT 'unsupported_entity', true) GROUP BY 1")
def audit_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports, and a made-up row that has to be rejected."""
    control = spark.createDataFrame([(-1, "Atlantis Ministry raised output 3.5 percent.", "2020-01-01")], "id long, txt string, event_date string")
    return _faithful(texts(spark, sf_dir).union(control)).groupBy("verdict").agg(F.count("*").alias("n"), F.bool_or((F.col("id") == -1) & (F.col("verdict") != "ok")).alias("control_rejected"))


@query(f"{ENTITIES} SELECT id, md5(list_reduce(list_prepend(raw, list_reverse(list_transform(list_sort(list_transform(e, lambda x: {{'n': len(x), 'x': x}})), lambda q: q.x))), lambda acc, x: replace(acc, x, 'a major entity'))) AS txt_md5 FROM v_ent")
def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.md5(L.anonymous(F.col("txt"), L.entities(F.col("txt")))).alias("txt_md5"))


@query(f"{X} SELECT id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(txt, '\\d{{4}}-\\d{{2}}-\\d{{2}}', ' ', 'g'), '\\b(19|20)\\d{{2}}\\b', ' ', 'g'), '\\d+\\.?\\d*'), ',') AS numbers FROM v_text")
def stated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("txt", L.ALL_SCRIPTS + r"\d{4}-\d{2}-\d{2}", " "), L.ALL_SCRIPTS + r"\b(19|20)\d{2}\b", " ")
    return texts(spark, sf_dir).select("id", F.array_join(L.all_of(bare, r"\d+\.?\d*"), ",").alias("numbers"))


JUDGE = "the price of the series"
JUDGED = f"""{X}, v_key AS (SELECT *, substr(sha1('{JUDGE}||' || raw), 1, 16) AS key FROM v_text),
v_cache AS (SELECT key, min(CASE WHEN quality = 1 THEN 'No.' ELSE 'Yes' END) AS answer FROM v_key JOIN labels ON doc_id = id WHERE quality IS NOT NULL GROUP BY 1)"""


@query(f"{JUDGED}, f AS (SELECT *, regexp_matches(txt, '{SQ(L.DIRECTION)}') AS flagged FROM v_key) SELECT id, flagged, flagged AND answer IS NULL AS unknown, flagged AND coalesce(contains(lower(answer), 'yes'), false) AS leak FROM f LEFT JOIN v_cache USING (key)")
def semantic_leak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a pattern flags and a cached answer confirms; without an answer no leak, but unknown. Others aren't looked up."""
    key = R.verdict_key(F.lit(JUDGE), F.array("txt"))
    t = texts(spark, sf_dir)
    said = V.table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "No.").otherwise("Yes").alias("answer"))
    cache = t.join(said, F.col("id") == F.col("doc_id")).groupBy(key.alias("key")).agg(F.min("answer").alias("answer"))
    flagged = t.select("id", L.has(F.col("txt"), L.DIRECTION).alias("flagged"), key.alias("key"))
    judged = flagged.where("flagged").join(cache, "key", "left")
    leak = F.coalesce(F.contains(F.lower("answer"), F.lit("yes")), F.lit(False))
    fine = flagged.where("not coalesce(flagged, false)").select("id", "flagged", F.lit(False).alias("unknown"), F.lit(False).alias("leak"))
    return judged.select("id", "flagged", F.col("answer").isNull().alias("unknown"), leak.alias("leak")).union(fine)


LEAD = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(txt), '[a-z][a-z''-]{2,}'), lambda w: NOT list_contains(['the', 'and', 'for', 'was', 'with'], w)))), ' ')"


@query(f"{X} SELECT id, md5({LEAD}) AS words_md5 FROM v_text")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array_except(L.all_of(F.lower("txt"), "[a-z][a-z'-]{2,}"), F.array(*map(F.lit, ("the", "and", "for", "was", "with"))))
    return texts(spark, sf_dir).select("id", F.md5(F.array_join(F.array_sort(w), " ")).alias("words_md5"))


@query(f"SELECT doc_id, (year AND word) AS leak FROM (SELECT doc_id, regexp_matches({V.folded('text')}, '\\b(19|20)\\d{{2}}\\b') AS year, regexp_matches(text, '(?i)license') AS word FROM documents)")
def context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", (L.has(F.col("text"), r"\b(19|20)\d{2}\b") & F.col("text").rlike("(?i)license")).alias("leak"))


POOL = (2.5, 3.2, 5.25, 4.5)


@query(f"{X}, n AS (SELECT id, list_filter(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda x: true) AS d FROM v_text) SELECT id, round(CASE WHEN len(d) = 0 THEN 0 ELSE len(list_filter(d, lambda n: len(list_filter([2.5, 3.2, 5.25, 4.5]::DOUBLE[], lambda p: abs(n - p) <= greatest(0.02 * abs(p), 1e-6))) > 0)) / len(d) END, 6)::DOUBLE AS rate FROM n")
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of stated decimals within 2 % of a number of the pool; 0 without any."""
    d = L.decimals(F.col("txt"))
    lost = L.unmatched(d, F.array(*map(F.lit, POOL)), 0.02, 1e-6)
    rate = F.when(F.size(d) == 0, 0.0).otherwise((F.size(d) - F.size(lost)) / F.size(d))
    return texts(spark, sf_dir).select("id", F.round(rate, 6).alias("rate"))


@query(f"""{X}, a AS (SELECT id, 1 AS attempt, raw AS txt FROM v_text UNION ALL SELECT id, 2, 'Rose 2.5 percent.' FROM v_text WHERE id % 3 = 0),
ok AS (SELECT * FROM a WHERE len(regexp_extract_all(txt, '\\d+\\.\\d+')) > 0 AND len(list_filter(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda n: abs(n - 2.5) > 0.02)) = 0),
f AS (SELECT id, arg_min(txt, attempt) AS txt FROM ok GROUP BY 1) SELECT v.id, coalesce(f.txt, 'fallback') AS described, f.id IS NOT NULL AS generated FROM v_text v LEFT JOIN f USING (id)""")
def grounded_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt whose numbers are grounded, else the fallback."""
    t = texts(spark, sf_dir).select("id", "txt")
    attempts = t.withColumn("attempt", F.lit(1)).unionByName(t.where("id % 3 = 0").select("id", F.lit("Rose 2.5 percent.").alias("txt"), F.lit(2).alias("attempt")))
    d = L.decimals(F.col("txt"))
    good = attempts.where((F.size(d) > 0) & (F.size(L.unmatched(d, F.array(F.lit(2.5)))) == 0)).groupBy("id").agg(F.min_by("txt", "attempt").alias("found"))
    return t.join(good, "id", "left").select("id", F.coalesce("found", F.lit("fallback")).alias("described"), F.col("found").isNotNull().alias("generated"))


@query(f"{X} SELECT id, len(list_filter(list_transform(regexp_extract_all(txt, '\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda n: abs(n - 3.2) <= 0.032 OR abs(n - 7.1) <= 0.071)) > 0 AS leak FROM v_text")
def text_leaks_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.decimals(F.col("txt"))
    return texts(spark, sf_dir).select("id", (F.size(L.unmatched(d, F.array(F.lit(3.2), F.lit(7.1)), 0.01, 0.0)) < F.size(d)).alias("leak"))


@query("SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)), lambda x: len(x) >= 40)[1], '') AS lead FROM documents")
def lead_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of 40 characters or more."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40)
    return V.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("lead"))


USABLE = "len({0}) >= 4 AND NOT contains({0}, ':') AND NOT starts_with({0}, 'List_of') AND NOT starts_with({0}, 'Wikipedia') AND {0} NOT IN ('Main_Page', '-')"


@query(f"WITH n AS (SELECT p_name AS name, p_partkey AS place FROM part UNION ALL SELECT source, doc_id FROM documents UNION ALL SELECT * FROM (VALUES ('Main_Page', 0), ('-', 0), ('Wikipedia_x', 0), ('List_of_x', 0), ('a:b c', 0)) t(name, place)) SELECT name FROM (SELECT name, min(place) AS first FROM n WHERE {USABLE.format('name')} GROUP BY 1) ORDER BY first, name LIMIT 50")
def collect_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 usable names that come first."""
    odd = spark.createDataFrame([(x, 0) for x in ("Main_Page", "-", "Wikipedia_x", "List_of_x", "a:b c")], "name string, at long")
    parts = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("at"))
    sources = V.table(spark, sf_dir, "documents").select("source", "doc_id")
    return R.first_names(parts.union(sources).union(odd), 50)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role = 'user' ELSE starts_with(role, 'a') END AS forecast FROM conversations")
def direction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit direction, else the prefix of the task."""
    direction = F.when(F.col("turn") % 3 == 0, F.when(F.col("role") == "user", "text_to_ts").otherwise("ts_to_text"))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(direction == "text_to_ts", F.startswith("role", F.lit("a"))).alias("forecast"))


QUERIES, ORACLES = query.queries, query.oracles
