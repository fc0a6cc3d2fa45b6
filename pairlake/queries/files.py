"""Scans and sinks: files written from the tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import tree_digest, tree_sql
from ..plans import views as V
from ..sources import files as X
from .common import Registry

query = Registry()
PRICE = f"WITH {V.PRICE}"


def _lines(rows: DataFrame, name: str) -> str:
    """The path of a folder of text files with the rows (value)."""
    path = X.scratch(rows.sparkSession, name)
    rows.write.text(path)
    return path


def _csv(rows: DataFrame, name: str, *keys: str) -> str:
    """The path of CSV files, in a folder for each key."""
    path = X.scratch(rows.sparkSession, name)
    rows.write.partitionBy(*keys).option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    return path


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.price(spark, sf_dir).select("series_id", "dt", F.round(F.col("price") * 0.137931, 2).alias("price"), "idx")  # an odd share, so that no tie is rounded


@query("SELECT doc_id, source, n_chars, NULL::VARCHAR AS corrupt FROM documents UNION ALL SELECT -1, NULL, -1, 'not json ' || doc_id FROM documents WHERE doc_id % 97 = 0")
def scan_jsonl_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of files of two makes, objects on lines and over lines, among lines that aren't JSON; those come back too."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    bad = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("not json "), F.col("doc_id").cast("string")))
    top = X.scratch(spark, "robust")
    for make, odd in (("lines", 0), ("pretty", 1)):
        record = F.to_json(F.struct("doc_id", "source", "n_chars"), {"pretty": "true"} if odd else {})
        d.where(F.pmod("doc_id", F.lit(2)) == odd).select(F.concat_ws("\n", record, bad).alias("value")).write.option("compression", "none").text(f"{top}/{make}")
    r = F.from_json("record", "doc_id long, source string, n_chars long")
    return X.json_records(spark, _renamed(spark, top)).select(r.alias("r"), "corrupt").select(F.coalesce("r.doc_id", F.lit(-1).cast("long")).alias("doc_id"), "r.source", F.coalesce("r.n_chars", F.lit(-1).cast("long")).alias("n_chars"), "corrupt")


def _renamed(spark: SparkSession, top: str) -> str:
    """The text files below a folder as .jsonl files in it; returns the folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{top}/*/part-*"))
    for i, f in enumerate(found):
        fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{top}/part{i}.jsonl"))
    return top


@query("SELECT conv_id, turn, role FROM conversations")
def scan_jsonl_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.scratch(spark, "simple")
    X.write_json_lines(V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), path)
    return X.json_lines(spark, path, "conv_id long, turn long, role string")


@query(f"{PRICE} SELECT strftime(dt, '%Y-%m-%d') AS date, round(price * 0.137931, 2) AS value FROM v_price WHERE idx % 7 <> 3")
def scan_price_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank values and "." are no observations."""
    p = prices(spark, sf_dir)
    value = F.when(F.col("idx") % 7 == 3, F.when(F.col("idx") % 2 == 0, ".").otherwise(" ")).otherwise(F.col("price").cast("string"))
    return X.price_csv(spark, _csv(p.select(F.date_format("dt", "yyyy-MM-dd").alias("date"), value.alias("value")), "prices"))


@query(f"{PRICE} SELECT series_id, strftime(dt, '%Y-%m-%d') AS date, round(price * 0.137931, 2) AS value FROM v_price")
def scan_commodity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each commodity."""
    p = prices(spark, sf_dir).select("series_id", F.date_format("dt", "yyyy-MM-dd").alias("date"), F.col("price").cast("string").alias("value"))
    return X.price_csv(spark, _csv(p, "commodity", "series_id"), "series_id")


@query(f"{PRICE} SELECT series_id, dt AS date, round(price * 0.137931, 2) AS value FROM v_price WHERE idx % 11 <> 4")
def scan_date_value_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in either layout; rows without a day are left out."""
    day = F.when(F.col("idx") % 11 == 4, "n/a").when(F.col("idx") % 2 == 0, F.date_format("dt", "M/d/yyyy")).otherwise(F.date_format("dt", "yyyy-MM-dd"))
    p = prices(spark, sf_dir).select("series_id", day.alias("day"), F.col("price").cast("string").alias("value"))
    return X.dated_csv(spark, _csv(p, "values", "series_id"), "day", "series_id", "value").select("series_id", "date", F.col("value").cast("double").alias("value"))


@query(f"{PRICE} SELECT series_id AS ticker, dt AS date, round(price * 0.137931, 2) AS close FROM v_price")
def aapl_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing prices of a file for each ticker."""
    p = prices(spark, sf_dir).select(F.col("series_id").alias("ticker"), F.date_format("dt", "yyyy-MM-dd").alias("date"), F.col("price").cast("string").alias("close"))
    return X.dated_csv(spark, _csv(p, "close", "ticker"), "date", "ticker", "close").select("ticker", "date", F.col("close").cast("double").alias("close"))


YIELDS = f"{PRICE}, y AS (SELECT dt AS date, max(round(price * 0.137931, 2)) FILTER (WHERE series_id = 'BUILDING') AS two_year, max(round(price * 0.137931, 2)) FILTER (WHERE series_id = 'MACHINERY') AS ten_year FROM v_price GROUP BY 1)"


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s, n: F.max(F.when(F.col("series_id") == s, F.col("price"))).alias(n)
    return prices(spark, sf_dir).groupBy(F.col("dt").alias("date")).agg(of("BUILDING", "two_year"), of("MACHINERY", "ten_year"))


@query(f"{YIELDS} SELECT strftime(date, '%Y-%m-%d') AS date, two_year, ten_year FROM y WHERE two_year IS NOT NULL AND ten_year IS NOT NULL")
def scan_treasury_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that lack a maturity are left out."""
    field = lambda n, c: F.coalesce(F.concat(F.lit(f"<d:{n}>"), c, F.lit(f"</d:{n}>")), F.lit(""))
    entry = F.concat(F.lit("<m:properties>"), field("NEW_DATE", F.date_format("date", "yyyy-MM-dd'T00:00:00'")), field("BC_2YEAR", F.col("two_year").cast("string")), field("BC_10YEAR", F.col("ten_year").cast("string")), F.lit("</m:properties>"))
    years = yields(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.array_join(F.collect_list(entry), "").alias("x"))  # a year's days
    path = X.scratch(spark, "yields")
    years.select("year", F.concat(F.lit('<feed xmlns:m="m" xmlns:d="d">'), "x", F.lit("</feed>")).alias("value")).write.partitionBy("year").text(path)
    return X.yields_xml(spark, path)


@query(f"{YIELDS} SELECT year(date)::INT AS year, count(*) AS n, round(sum(two_year), 1) AS two_year FROM y WHERE two_year IS NOT NULL AND ten_year IS NOT NULL GROUP BY 1")
def fetch_cached_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly cache files as one table; nothing is downloaded, and an empty cache is an error."""
    y = yields(spark, sf_dir).dropna().withColumn("year", F.year("date"))
    path = X.scratch(spark, "yearly")
    y.write.partitionBy("year").option("header", "true").csv(path)
    got = X.cached_years(spark, path, "date date, two_year double, ten_year double, year int")
    return got.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("two_year"), 1).alias("two_year"))


@query(f"{YIELDS} SELECT 'two_year' AS maturity, date, two_year AS value FROM y WHERE two_year IS NOT NULL AND ten_year IS NOT NULL UNION ALL SELECT 'ten_year', date, ten_year FROM y WHERE two_year IS NOT NULL AND ten_year IS NOT NULL")
def load_treasury_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache as two series."""
    y = yields(spark, sf_dir).dropna().select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("two_year").cast("string").alias("two_year"), F.col("ten_year").cast("string").alias("ten_year"))
    got = X.dated_csv(spark, _csv(y, "pair"), "date", "two_year", "ten_year")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("maturity"), F.col(m).cast("double").alias("value")) for m in ("two_year", "ten_year"))))
    return got.select("date", each.alias("e")).select("e.maturity", "date", "e.value")


def _until(due: str, fine: str) -> str:
    return f"{PRICE}, r AS (SELECT series_id, dt AS date, round(price * 0.137931, 2) AS value FROM v_price WHERE {fine} AND dt <= DATE '{due}') SELECT * FROM r WHERE series_id IN (SELECT series_id FROM r GROUP BY 1 HAVING count(*) >= 30)"


@query(_until("1997-06-30", "idx % 5 <> 2"))
def scan_fred_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories up to the due date, of 30 points or more, from a file for each series; "." is no observation."""
    p = prices(spark, sf_dir).select("series_id", F.date_format("dt", "yyyy-MM-dd").alias("date"), F.when(F.col("idx") % 5 == 2, ".").otherwise(F.col("price").cast("string")).alias("value"))
    got = X.price_csv(spark, _csv(p, "fred", "series_id"), "series_id")
    return X.until(got.withColumn("date", F.to_date("date")), "1997-06-30")


@query(_until("1996-06-30", "idx % 9 <> 1"))
def scan_yahoo_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from quotes by epoch seconds as JSON lines, a file for each ticker; a null close is no observation."""
    close = F.when(F.col("idx") % 9 != 1, F.col("price"))
    path = X.scratch(spark, "yahoo")
    prices(spark, sf_dir).select("series_id", F.unix_date("dt").cast("long").alias("day"), close.alias("close")).select("series_id", (F.col("day") * 86400).alias("timestamp"), "close").write.partitionBy("series_id").json(path)
    got = spark.read.schema("timestamp long, close double, series_id string").json(path).where("close is not null")
    return X.until(got.select("series_id", F.date_from_unix_date((F.col("timestamp") / 86400).cast("int")).alias("date"), F.col("close").alias("value")), "1996-06-30")


@query("SELECT c_name AS cve, round(c_acctbal / 100 * 100, 2) AS score FROM customer WHERE c_custkey % 3 = 0")
def scan_epss_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's scores of the targets, in hundredths."""
    c = V.table(spark, sf_dir, "customer")
    rows = c.select(F.concat_ws(",", "c_name", (F.col("c_acctbal") / 100).cast("string"), F.lit("0.5")).alias("value"))
    head = spark.createDataFrame([("#model_version:v1,score_date:2024-01-05T00:00:00+0000",), ("cve,epss,percentile",)], "value string")
    targets = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("cve"))
    return X.epss_csv(spark, _lines(head.union(rows), "epss"), "2024-01-05", targets)


@query("WITH s AS (SELECT o_custkey AS id, o_orderdate::DATE AS day, max(o_totalprice) AS score FROM orders GROUP BY ALL), t AS (SELECT id, min(day) + 400 AS added FROM s GROUP BY 1), w AS (SELECT t.id, added::DATE AS added, count(*) AS n, round(sum(score), 2) AS total FROM t JOIN s ON t.id = s.id AND s.day BETWEEN t.added - 300 AND t.added + 300 GROUP BY ALL) SELECT id, added, n::INT AS n, total FROM w WHERE n >= 5")
def epss_window_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's scores of the days around the day it was added, where there are enough."""
    s = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("score"))
    t = s.groupBy("id").agg(F.date_add(F.min("day"), 400).alias("added"))
    w = X.snapshots_window(t, s, 300, 300, 5)
    return w.select("id", "added", "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


SCOPE = "WITH rows AS (SELECT 0 AS scope, p_name || '_' || p_partkey AS id FROM part WHERE p_size >= 10), " + tree_sql("rows", "scope", "id", "id", 64)


@query(f"{SCOPE} SELECT n, substr(line, 1, 8) AS scope FROM tree_3")
def kev_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets from a least date on (here a size), and a digest of which they are: a tree over the sorted ids."""
    ids = V.table(spark, sf_dir, "part").where("p_size >= 10").select(F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("id"))
    return tree_digest(ids, [], ["id"], F.col("id"), 64).select("n", F.substring("digest", 1, 8).alias("scope"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of its records for each source, and a ledger of its short ones; the tasks write them."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "md5": "'), F.md5("text"), F.lit('"}'))
    top = X.scratch(spark, "found")
    X.write_files(d, "source", "doc_id", line, top, ".jsonl")
    X.write_files(d.where(F.length("text") < 500), "source", "doc_id", line, f"{top}/ledgers", ".rejected.jsonl")
    return top


LINES = """WITH l AS (SELECT doc_id, coalesce(source, 'none') AS source, len(coalesce(text, '')) AS n, '{"id": ' || doc_id || ', "md5": "' || md5(coalesce(text, '')) || '"}' || chr(10) AS line FROM documents),
f AS (SELECT source || '.jsonl' AS file, string_agg(line, '' ORDER BY doc_id) AS content FROM l GROUP BY 1 UNION ALL SELECT source || '.rejected.jsonl', string_agg(line, '' ORDER BY doc_id) FROM l WHERE n < 500 GROUP BY 1)"""


def _name():
    return F.element_at(F.split("file", "/"), -1).alias("file")


@query(f"{LINES} SELECT file FROM f WHERE NOT ends_with(file, '.rejected.jsonl')")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.discover_files(spark, _files(spark, sf_dir)).select(_name())


@query(f"{LINES} SELECT file FROM f")
def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.find_files(spark, _files(spark, sf_dir)).select(_name())


@query(f"WITH {V.REGISTRY}, n AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1) SELECT n.name, n.n, coalesce(a.source, n.name) AS registered_as, coalesce(r.status, 'review_required') AS status FROM n LEFT JOIN v_alias a ON n.name = a.alias LEFT JOIN v_reg r ON coalesce(a.source, n.name) = r.source")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that documents come from, and what the registry says of them."""
    reg, aliases = V.registry(spark)
    n = V.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    n = n.join(aliases.toDF("alias", "of"), F.col("name") == F.col("alias"), "left").withColumn("registered_as", F.coalesce("of", "name"))
    return n.join(reg.select("source", "status"), F.col("registered_as") == F.col("source"), "left").select("name", "n", "registered_as", F.coalesce("status", F.lit("review_required")).alias("status"))


@query("SELECT doc_id, lang FROM documents")
def sink_jsonl_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice: the second output takes the first one's place whole."""
    path = X.scratch(spark, "sink")
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    X.write_json_lines(d.limit(1), path)
    X.write_json_lines(d, path)
    return X.json_lines(spark, path, "doc_id long, lang string")


SUMMARY = "SELECT coalesce(source, 'none') AS source, count(*) AS n FROM documents GROUP BY 1"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


@query(SUMMARY)
def sink_json_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.scratch(spark, "value") + ".json"
    X.write_json(spark, {r["source"]: r["n"] for r in summary(spark, sf_dir).collect()}, path)  # a row for each source
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")))
    return whole.select(F.col("key").alias("source"), F.col("value").alias("n"))


@query(SUMMARY)
def sink_html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.scratch(spark, "report") + ".html"
    X.write_html(summary(spark, sf_dir), path)
    cell = lambda k: F.regexp_extract("value", "^<tr><td>(.*?)</td><td>(.*?)</td></tr>$", k)
    return spark.read.text(path).where(F.startswith("value", F.lit("<tr><td>"))).select(cell(1).alias("source"), cell(2).cast("long").alias("n"))


@query(f"{LINES} SELECT file, strlen(content) AS bytes, sha256(content) AS sha256 FROM f")
def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.file_digests(spark, _files(spark, sf_dir)).select(_name(), "bytes", "sha256")


@query(f"{PRICE} SELECT series_id, dt AS date, round(price * 0.137931, 2) AS value FROM v_price")
def timemmd_scan_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates come in two layouts."""
    day = F.when(F.col("idx") % 2 == 0, F.date_format("dt", "yyyy-MM-dd")).otherwise(F.date_format("dt", "M/d/yyyy"))
    p = prices(spark, sf_dir).select("series_id", day.alias("start_date"), F.col("price").cast("string").alias("OT"))
    return X.dated_csv(spark, _csv(p, "numeric"), "start_date", "OT", "series_id").select("series_id", "date", F.col("OT").cast("double").alias("value"))


@query(f"WITH {V.ARTICLE} SELECT article_id, day AS date, md5(title) AS fact_md5 FROM v_article WHERE title <> '' OR article_id % 2 = 0")
def timemmd_scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that state a fact or a prediction."""
    a = V.article(spark, sf_dir).select(F.col("article_id").cast("string").alias("id"), F.date_format("day", "M/d/yyyy").alias("end_date"), F.base64(F.encode("title", "utf-8")).alias("fact"), F.when(F.col("article_id") % 2 == 0, "up").otherwise("").alias("preds"))
    got = X.dated_csv(spark, _csv(a, "reports"), "end_date", "id", "fact", "preds")
    got = got.where((F.coalesce("fact", F.lit("")) != "") | (F.coalesce("preds", F.lit("")) != ""))
    return got.select(F.col("id").cast("long").alias("article_id"), "date", F.md5(F.unbase64(F.coalesce("fact", F.lit("")))).alias("fact_md5"))


@query("SELECT conv_id, first(role ORDER BY turn) AS role FROM conversations GROUP BY 1")
def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's first row that isn't blank, a conversation standing for a file."""
    c = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), F.to_json(F.struct("role")).alias("record"))
    blank = c.select("file", F.lit(-1).cast("long").alias("pos"), F.lit(" ").alias("record")).distinct()
    return X.first_record(c.union(blank)).select(F.col("file").alias("conv_id"), F.get_json_object("record", "$.role").alias("role"))


REGISTERED = """WITH d AS (SELECT source, count(*) AS n, min(doc_id) AS least FROM documents WHERE source IS NOT NULL GROUP BY 1),
r AS (SELECT source, ['approved', 'conditional', 'perhaps', NULL, 'blocked'][least % 5 + 1] AS status FROM d), a AS (SELECT DISTINCT lang || '-' || source AS alias, CASE WHEN lang = 'fr' THEN 'no-' || source ELSE source END AS source FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"""


@query(f"{REGISTERED} SELECT source AS name, 'status' AS error FROM r WHERE status IS NULL OR status NOT IN ('approved', 'conditional', 'review_required', 'blocked') UNION ALL SELECT alias, 'alias' FROM a WHERE source NOT IN (SELECT source FROM r)")
def load_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a registry of the documents' sources and of their names by language, written and read from its files."""
    d = V.table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    status = F.array(*(F.lit(x) for x in ("approved", "conditional", "perhaps", None, "blocked")))
    reg = d.groupBy("source").agg(F.min("doc_id").alias("least")).select("source", F.get(status, (F.col("least") % 5).cast("int")).alias("status"))
    target = F.when(F.col("lang") == "fr", F.concat(F.lit("no-"), "source")).otherwise(F.col("source"))
    aliases = d.where(F.col("lang").isNotNull()).select(F.concat_ws("-", "lang", "source").alias("alias"), target.alias("source")).distinct()
    path = X.scratch(spark, "registry")
    X.write_json_lines(reg, f"{path}/sources")
    X.write_json_lines(aliases, f"{path}/aliases")
    return X.registry_errors(X.json_lines(spark, f"{path}/sources", "source string, status string"), X.json_lines(spark, f"{path}/aliases", "alias string, source string"))


QUERIES, ORACLES = query.queries, query.oracles
