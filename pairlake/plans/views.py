"""The views. Each function gives a DataFrame; the constant beside it the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price by market segment: series_id, dt, price, idx. One shuffle pair, segments as keys."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dt"), "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    daily = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("series_id", "dt").agg(F.avg("o_totalprice").alias("price"))
    return daily.withColumn("idx", F.row_number().over(Window.partitionBy("series_id").orderBy("dt")) - 1)


PRICE = """v_price AS (
  SELECT series_id, dt, price, (row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1)::INT AS idx FROM (
    SELECT c_mktsegment AS series_id, o_orderdate::DATE AS dt, avg(o_totalprice) AS price
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by type: entity, idx, hour, v."""
    hourly = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("v"))
    return hourly.withColumn("idx", F.row_number().over(Window.partitionBy("entity").orderBy("hour")) - 1)


VIEWS = """v_views AS (
  SELECT entity, hour, v, (row_number() OVER (PARTITION BY entity ORDER BY hour) - 1)::INT AS idx FROM (
    SELECT event_type AS entity, date_trunc('hour', ts) AS hour, count(*)::DOUBLE AS v FROM events GROUP BY ALL))"""


def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated articles: article_id, day, title (the whole text), domain."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.pmod(F.col("doc_id") * 37, F.lit(2400))).cast("int"))
    return d.select(F.col("doc_id").alias("article_id"), day.alias("day"), F.coalesce("text", F.lit("")).alias("title"), F.col("source").alias("domain"))


ARTICLE = """v_article AS (
  SELECT doc_id AS article_id, DATE '1995-01-01' + (doc_id * 37 % 2400)::INT AS day, coalesce(text, '') AS title, source AS domain FROM documents)"""


def err(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three errors for each user and day: series_id, domain, err_a, err_b, err_c."""
    e = table(spark, sf_dir, "events")
    out = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("err_a"), F.min("value").alias("err_b"), F.max("value").alias("err_c"))
    key = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd"))
    return out.select(key.alias("series_id"), F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("domain"), "day", "err_a", "err_b", "err_c")


ERR = """v_err AS (
  SELECT user_id || '_' || strftime(day, '%Y-%m-%d') AS series_id, 'g' || (user_id % 7) AS domain, day, err_a, err_b, err_c FROM (
    SELECT user_id, ts::DATE AS day, avg(value) AS err_a, min(value) AS err_b, max(value) AS err_c FROM events GROUP BY ALL))"""


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved forecasts: id, domain, horizon, p_up, human, resolved_to."""
    o = table(spark, sf_dir, "orders")
    horizon = F.element_at(F.array(*(F.lit(h) for h in (5, 21, 65, 129, 260))), (F.col("o_orderkey") % 5).cast("int") + 1)
    domain = F.when(F.col("o_orderkey") % 3 == 0, "fred").otherwise("yahoo")
    y = F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0)
    return o.select(F.col("o_orderkey").alias("id"), domain.alias("domain"), horizon.alias("horizon"), ((F.col("o_orderkey") * 7 % 101) / 101.0).alias("p_up"), ((F.col("o_custkey") * 11 % 97) / 97.0).alias("human"), y.alias("resolved_to"))


PROB = """v_prob AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'fred' ELSE 'yahoo' END AS domain,
    list_extract([5, 21, 65, 129, 260], (o_orderkey % 5 + 1)::INT) AS horizon, (o_orderkey * 7 % 101) / 101.0::DOUBLE AS p_up,
    (o_custkey * 11 % 97) / 97.0::DOUBLE AS human, CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END::DOUBLE AS resolved_to FROM orders)"""


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of many models: model, id, forecast."""
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"), F.col("l_orderkey").alias("id")).agg((F.max("l_discount") * 10).alias("forecast"))


MODEL = """v_model AS (SELECT 'm' || l_suppkey AS model, l_orderkey AS id, max(l_discount) * 10 AS forecast FROM lineitem GROUP BY ALL)"""


def item(spark: SparkSession, sf_dir: str, history: int = 10, future: int = 5) -> DataFrame:
    """Forecast windows at every point: series_id, dataset, origin, kt, history, future, text (latest article before)."""
    p = price(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("idx")
    points = p.withColumns({
        "history": F.collect_list("price").over(w.rowsBetween(-history, -1)),
        "future": F.collect_list("price").over(w.rowsBetween(0, future - 1)),
    }).where((F.size("history") == history) & (F.size("future") == future))
    from ..operators.retrieve import asof_backward

    texts = article(spark, sf_dir).select("article_id", "title")
    days = article(spark, sf_dir).groupBy("day").agg(F.max("article_id").alias("latest"))
    got = asof_backward(points.withColumn("day", F.col("dt")), days, "day", by=[], value=["latest", "day"], strict=True)
    got = got.join(texts, got["right_latest"] == texts["article_id"], "left")
    key = F.concat_ws("_", "series_id", F.date_format("dt", "yyyy-MM-dd"))
    return got.select(key.alias("series_id"), F.col("series_id").alias("dataset"), F.col("dt").alias("origin"), F.col("right_day").alias("kt"), "history", "future", F.coalesce("title", F.lit("")).alias("text"))


def ragged(spark: SparkSession, sf_dir: str, history: int = 10, future: int = 5) -> DataFrame:
    """Every point with as much history and future as there is: series_id, idx, history, future. In ITEM it is v_point."""
    w = Window.partitionBy("series_id").orderBy("idx")
    return price(spark, sf_dir).select("series_id", "idx", F.collect_list("price").over(w.rowsBetween(-history, -1)).alias("history"), F.collect_list("price").over(w.rowsBetween(0, future - 1)).alias("future"))


ITEM = (
    PRICE
    + ", "
    + ARTICLE
    + """, v_day AS (SELECT day, max_by(title, article_id) AS title FROM v_article GROUP BY day),
v_point AS (
  SELECT *, list(price) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS history,
    list(price) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS future FROM v_price),
v_item AS (
  SELECT p.series_id || '_' || strftime(p.dt, '%Y-%m-%d') AS series_id, p.series_id AS dataset, p.dt AS origin, d.day AS kt, history, future, coalesce(d.title, '') AS text
  FROM (SELECT * FROM v_point WHERE len(history) = 10 AND len(future) = 5) p ASOF LEFT JOIN v_day d ON p.dt > d.day)"""
)


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents for the text gates: id, txt, event_date (text)."""
    return article(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("title").alias("txt"), F.date_format("day", "yyyy-MM-dd").alias("event_date"))


def folded(column: str) -> str:
    """SQL of a text with each letter, mark and digit beyond ASCII as an underscore: to DuckDB's patterns words are ASCII words."""
    return f"regexp_replace({column}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '_', 'g')"


TEXT = ARTICLE + f", v_text AS (SELECT article_id AS id, title AS raw, {folded('title')} AS txt, strftime(day, '%Y-%m-%d') AS event_date FROM v_article)"


def registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(source, status, license, terms_url, attribution), (alias, source)."""
    return spark.createDataFrame(SOURCES, "source string, status string, license string, terms_url string, attribution string"), spark.createDataFrame(ALIASES, "alias string, source string")


SOURCES = [
    ("src0", "approved", "CC-BY-4.0", "https://example.org/0", None),
    ("src1", "conditional", "CC-BY-SA-4.0", "https://example.org/1", "Example One"),
    ("src2", "conditional", "ODbL-1.0", "https://example.org/2", None),
    ("src3", "blocked", "proprietary", None, None),
    ("src4", "review_required", "NOASSERTION", None, None),
    ("src5", "approved", "", "https://example.org/5", None),
]
ALIASES = [("src6", "src0"), ("src7", "src1"), ("src8", "src3")]


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else "'{}'".format(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


REGISTRY = f"v_reg(source, status, license, terms_url, attribution) AS (VALUES {_values(SOURCES)}), v_alias(alias, source) AS (VALUES {_values(ALIASES)})"
