"""Splits, arms, baseline forecasts, errors and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import evaluate as E
from ..operators.order import medians
from ..plans import views as V
from .common import Registry, r6

query = Registry()
ITEM = f"WITH {V.ITEM}, v_g AS (SELECT *, dataset || ':' || regexp_extract(series_id, '^(.*?)_\\d{{4}}-\\d{{2}}-\\d{{2}}', 1) AS grp FROM v_item)"
ERR = f"WITH {V.ERR}"
CUT = "1998-06-01"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.item(spark, sf_dir).withColumn("grp", E.series_group(F.col("series_id"), F.col("dataset")))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.err(spark, sf_dir)


@query(f"{ITEM} SELECT series_id AS dataset, count(*) AS n, min(idx)::INT AS first_point, round(sum(list_sum(history)) / 1e6, 4) AS history FROM v_point WHERE series_id NOT IN ('FURNITURE') AND len(history) >= 2 AND len(future) >= 1 GROUP BY 1")
def forecast_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the listed datasets with two points of history and one to forecast."""
    fine = V.ragged(spark, sf_dir).where((F.col("series_id") != "FURNITURE") & (F.size("history") >= 2) & (F.size("future") >= 1))
    out = fine.groupBy(F.col("series_id").alias("dataset"))
    return out.agg(F.count("*").alias("n"), F.min("idx").cast("int").alias("first_point"), F.round(F.sum(S.total(F.col("history"))) / 1e6, 4).alias("history"))


@query(f"{ITEM} SELECT series_id, grp FROM v_g")
def series_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("series_id", "grp")


@query(f"{ITEM}, h AS (SELECT *, dataset || '_' || (year(origin) % 3) AS g2 FROM v_g), s AS (SELECT *, CASE WHEN origin < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM h) SELECT series_id, split FROM s WHERE split = 'test' OR g2 NOT IN (SELECT g2 FROM s WHERE split = 'test' AND year(origin) = 2000) ")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("grp", F.concat_ws("_", "dataset", (F.year("origin") % 3).cast("string")))
    split = E.time_split(i, F.lit(CUT).cast("date"))
    late = split.where((F.col("split") == "test") & (F.year("origin") == 2000)).select("grp").distinct()
    kept = split.where("split = 'test'").unionByName(split.where("split = 'train'").join(late, "grp", "left_anti"))
    return kept.select("series_id", "split")


@query(f"{ITEM}, h AS (SELECT series_id, origin, dataset || '_' || (month(origin) % 5) AS g FROM v_g), s AS (SELECT *, CASE WHEN origin < DATE '1999-06-01' THEN 'train' ELSE 'test' END AS split FROM h) SELECT split, count(*) AS n FROM s WHERE split = 'test' OR g NOT IN (SELECT g FROM s WHERE split = 'test') GROUP BY 1")
def time_split_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("grp", F.concat_ws("_", "dataset", (F.month("origin") % 5).cast("string")))
    return E.time_split(i, F.lit("1999-06-01").cast("date"), purge=True).groupBy("split").agg(F.count("*").alias("n"))


@query(f"{ITEM}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY origin) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM v_g) SELECT series_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chronological(items(spark, sf_dir), "dataset", "origin", 0.8).select("series_id", "split")


@query(f"{ITEM} SELECT series_id, count(*) OVER (PARTITION BY dataset, year(origin)) >= 2 AS shuffleable FROM v_g")
def partition_shuffleable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("dataset", F.year("origin"))
    return items(spark, sf_dir).select("series_id", (F.count("*").over(w) >= 2).alias("shuffleable"))


#: Equal texts are neighbours in the order of their digests; the shift parts them.
ARMS = f"""{ITEM}, d AS (SELECT *, md5('7:' || text) AS digest, md5('7:' || series_id) AS lot FROM v_g),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY digest, lot, series_id) - 1 AS pos, count(*) OVER (PARTITION BY dataset) AS n, count(*) OVER (PARTITION BY dataset, digest) AS c FROM d),
l AS (SELECT dataset AS ds, max(n) AS items, max(c) AS m FROM o WHERE n >= 2 GROUP BY 1),
h AS (SELECT *, CASE WHEN 2 * m <= items THEN m + (7 * 7919 + items * 104729) % 2147483647 % (items - 2 * m + 1) WHEN m < items THEN m ELSE 1 END AS shift FROM l),
s AS (SELECT o.*, x.text AS other, x.digest = o.digest AS same FROM o JOIN h ON o.dataset = ds JOIN o x ON x.dataset = ds AND x.pos = (o.pos + shift) % items),
a AS (SELECT series_id, dataset, history, future, 'A_no_text' AS arm, '' AS arm_text, false AS collides FROM s UNION ALL SELECT series_id, dataset, history, future, 'B_flywheel_text', text, false FROM s UNION ALL SELECT series_id, dataset, history, future, 'C_shuffled_text', other, same FROM s)"""


def armed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.arms(items(spark, sf_dir), "dataset", "series_id")


@query(f"{ARMS} SELECT series_id, arm, arm_text, collides FROM a")
def make_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return armed(spark, sf_dir).select("series_id", "arm", "arm_text", "collides")


@query(f"{ARMS} SELECT dataset, items, m AS largest, shift, greatest(2 * m - items, 0) AS collisions FROM h JOIN (SELECT dataset FROM s GROUP BY 1) ON ds = dataset")
def arm_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.arms_report(items(spark, sf_dir), "dataset", "series_id")


@query(f"{ARMS}, p AS (SELECT arm, series_id, CASE WHEN series_id < 'F' THEN 'train' ELSE 'test' END AS part, dataset, collides FROM a) SELECT arm, part, count(*) AS n, count(DISTINCT dataset) AS datasets, count(*) FILTER (WHERE collides) AS collisions FROM p GROUP BY ALL")
def export_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("series_id") < "F", "train").otherwise("test")
    return armed(spark, sf_dir).groupBy("arm", part.alias("part")).agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"), F.count_if("collides").alias("collisions"))


@query(f"{ITEM} SELECT series_id, round(history[10] * 5, 4) AS total FROM v_g")
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("series_id", F.round(S.total(S.last_value(F.col("history"), 5)), 4).alias("total"))


TREND = f"""{ITEM}, t AS (SELECT *, list_avg(history) AS my, list_sum(list_transform(range(10), lambda i: (i - 4.5) * (history[i + 1] - list_avg(history)))) / 82.5 AS slope FROM v_g),
m AS (SELECT *, list_transform(range(5), lambda h: my + slope * (10 + h - 4.5)) AS fc, list_avg(list_transform(range(2, 11), lambda i: abs(history[i] - history[i - 1]))) AS step FROM t)"""


@query(f"{TREND} SELECT series_id, round(fc[1], 4) AS first_fc, round(fc[5], 4) AS last_fc FROM m")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.linear_trend(F.col("history"), 5)
    return items(spark, sf_dir).withColumn("fc", f).select("series_id", F.round(F.col("fc")[0], 4).alias("first_fc"), F.round(F.col("fc")[4], 4).alias("last_fc"))


LV = "list_avg(list_transform(range(1, 6), lambda i: abs(history[10] - future[i])))"
LT = "list_avg(list_transform(range(1, 6), lambda i: abs(fc[i] - future[i])))"


def _mase(rows: DataFrame, **how) -> DataFrame:
    h, f = F.col("history"), F.col("future")
    return rows.withColumns({"last": S.mase(S.last_value(h, 5), f, h, **how), "trend": S.mase(S.linear_trend(h, 5), f, h, **how)})


@query(f"{TREND} SELECT series_id, round({LV} / CASE WHEN step = 0 THEN 1e-6 ELSE step END, 6) AS last, round({LT} / CASE WHEN step = 0 THEN 1e-6 ELSE step END, 6) AS trend FROM m")
def mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mase(items(spark, sf_dir)).select("series_id", r6("last").alias("last"), r6("trend").alias("trend"))


@query(f"{TREND} SELECT series_id, round({LV} / greatest(step, 1e-3), 6) AS last FROM m")
def mase_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mase(items(spark, sf_dir), floor=1e-3, replace_zero=False).select("series_id", r6("last").alias("last"))


@query(f"{TREND} SELECT dataset, round(median({LV} / step), 6) AS last, round(median({LT} / step), 6) AS trend FROM m GROUP BY 1")
def eval_arm_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = medians(_mase(items(spark, sf_dir)), ["dataset"], {"last": F.col("last"), "trend": F.col("trend")}, "series_id")
    return m.select("dataset", r6("last").alias("last"), r6("trend").alias("trend"))


@query(f"{TREND}, x AS (SELECT dataset, {LV} / step AS last, {LT} / step AS trend, kt IS NULL OR kt >= origin AS leak FROM m) SELECT dataset, count(*) AS n, count(*) FILTER (WHERE last < trend) AS last_wins FROM x WHERE NOT leak GROUP BY 1")
def cpt_floor_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = items(spark, sf_dir).where(F.col("kt") < F.col("origin"))
    return _mase(fine).groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("last") < F.col("trend")).alias("last_wins"))


@query(f"{ITEM}, c AS (SELECT series_id AS dataset, list_concat(coalesce(history, []), coalesce(future, [])) AS v FROM v_point) SELECT dataset, count(*) FILTER (WHERE len(v) >= 12) AS kept, count(*) FILTER (WHERE len(v) < 12) AS skipped, round(avg(list_sum(v[-4:])) FILTER (WHERE len(v) >= 12) / 1e6, 6) AS held_out FROM c GROUP BY 1")
def cpt_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four values are held out; series with under eight before them are skipped and counted."""
    c = V.ragged(spark, sf_dir).select(F.col("series_id").alias("dataset"), F.concat("history", "future").alias("v"))
    fits = F.size("v") >= 12
    return c.groupBy("dataset").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped"), r6(F.avg(F.when(fits, S.total(F.slice("v", -4, 4)))) / 1e6).alias("held_out"))


@query(f"{ITEM} SELECT dataset, count(*) FILTER (WHERE kt IS NULL OR kt >= origin - 1) AS leaked, count(*) AS total FROM v_g GROUP BY 1")
def leak_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("kt").isNull() | (F.col("kt") >= F.date_sub("origin", 1))
    return items(spark, sf_dir).groupBy("dataset").agg(F.count_if(late).alias("leaked"), F.count("*").alias("total"))


@query(f"{ERR} SELECT domain, count(*) AS n, count(*) FILTER (WHERE err_b < err_a) AS b_over_a, count(*) FILTER (WHERE err_b < err_c) AS b_over_c FROM v_err GROUP BY 1")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("err_b") < F.col("err_a")).alias("b_over_a"), F.count_if(F.col("err_b") < F.col("err_c")).alias("b_over_c"))


def _bootstrap(group: str, iterations: int, seed: int) -> str:
    """SQL of the interval: each draw joins all rows of its group."""
    return f"""{ERR}, d AS (SELECT {group} AS g, err_a - err_b AS d FROM v_err), g AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM d)),
w AS (SELECT i, j, ((((i * 1000003 + j * 7919 + {seed} * 104729) % 2147483647) * 1103515245 + 12345) % 2147483648) // 8 % n AS no FROM (SELECT DISTINCT n FROM g), range({iterations}) a(i), LATERAL (SELECT unnest(range(n)) AS j)),
m AS (SELECT i, median(d) AS med FROM w JOIN g USING (no) JOIN d USING (g) GROUP BY 1), l AS (SELECT list_sort(list(med)) AS m FROM m)
SELECT (SELECT count(*) FROM g) AS clusters, round((SELECT median(d) FROM d), 6) AS point, round(m[{int(0.025 * iterations)} + 1], 6) AS lo, round(m[{int(0.975 * iterations)} + 1], 6) AS hi FROM l"""


def _interval(spark: SparkSession, sf_dir: str, group, iterations: int, seed: int) -> DataFrame:
    d = errors(spark, sf_dir).select(group.alias("g"), (F.col("err_a") - F.col("err_b")).alias("d"))
    point = d.agg(F.countDistinct("g").alias("clusters"), F.median("d").alias("point"))
    both = point.join(F.broadcast(E.interval(E.cluster_bootstrap(d, "g", "d", iterations, seed), iterations)))  # one row each
    return both.select("clusters", r6("point").alias("point"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(_bootstrap("domain", 200, 11))
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median gain, and the 2.5 and 97.5 index percentiles of 200 medians resampled by domain."""
    return _interval(spark, sf_dir, F.col("domain"), 200, 11)


@query(_bootstrap("strftime(day, '%Y-%m-%d')", 100, 13))
def bootstrap_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each day a cluster of its own."""
    return _interval(spark, sf_dir, F.date_format("day", "yyyy-MM-dd"), 100, 13)


@query(f"{ERR}, e AS (SELECT domain, day, avg(err_a) AS a, avg(err_b) AS b FROM v_err GROUP BY ALL) SELECT domain, round(median(a - b), 6) AS median, count(*) FILTER (WHERE b < a) AS wins FROM e GROUP BY 1")
def seed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = errors(spark, sf_dir).groupBy("domain", "day").agg(F.avg("err_a").alias("a"), F.avg("err_b").alias("b"))
    return e.groupBy("domain").agg(r6(F.median(F.col("a") - F.col("b"))).alias("median"), F.count_if(F.col("b") < F.col("a")).alias("wins"))


@query(f"{ERR}, r AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY err_a, series_id) AS x, row_number() OVER (PARTITION BY domain ORDER BY err_b, series_id) AS y FROM v_err) SELECT domain, round(coalesce(corr(x, y), 0), 6) AS rho FROM r GROUP BY 1")
def spearman_noties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spearman(errors(spark, sf_dir), "err_a", "err_b", "series_id", "domain").select("domain", r6("rho").alias("rho"))


@query(f"{ERR}, u AS (SELECT domain, series_id, err_a - err_b AS u FROM v_err) SELECT domain, round(median(u), 6) AS median, round(avg(u), 6) AS mean, round(avg((u > 0)::INT) * 100, 4) AS helped, max_by(series_id, struct_pack(a := u, b := series_id)) AS best FROM u GROUP BY 1")
def usefulness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = errors(spark, sf_dir).select("domain", "series_id", (F.col("err_a") - F.col("err_b")).alias("u"))
    rest = u.groupBy("domain").agg(r6(F.avg("u")).alias("mean"), F.round(F.avg((F.col("u") > 0).cast("int")) * 100, 4).alias("helped"), F.max_by("series_id", F.struct("u", "series_id")).alias("best"))
    return rest.join(medians(u, ["domain"], {"median": F.col("u")}, "series_id"), "domain").withColumn("median", r6("median"))


@query(f"""{ERR}, n AS (SELECT greatest(1, count(*) // 4) AS q, count(*) AS n FROM v_err), r AS (SELECT *, row_number() OVER (ORDER BY err_a DESC, series_id) AS d, row_number() OVER (ORDER BY err_a, series_id) AS u FROM v_err)
SELECT any_value(n) AS n, round(median(err_a - err_b) FILTER (WHERE d <= q), 6) AS hard, round(median(err_a - err_b) FILTER (WHERE u <= q), 6) AS easy, round(median(err_c - err_b), 6) AS content,
  CASE WHEN median(err_c - err_b) > 0.001 THEN 'content' WHEN median(err_c - err_b) < -0.05 THEN 'harm' ELSE 'channel' END AS verdict FROM r, n""")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.complementarity(errors(spark, sf_dir)).select("n", r6("hard").alias("hard"), r6("easy").alias("easy"), r6("content").alias("content"), "verdict")


@query(f"{ERR}, b AS (SELECT domain, CASE WHEN day(day) < 15 THEN 'early' ELSE 'late' END AS half, err_a - err_b AS g FROM v_err) SELECT coalesce(domain, 'ALL') AS domain, coalesce(half, 'ALL') AS half, round(avg(g), 6) AS gain, count(*) AS k FROM b GROUP BY GROUPING SETS ((domain), (half), ())")
def s9_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = errors(spark, sf_dir).select("domain", F.when(F.dayofmonth("day") < 15, "early").otherwise("late").alias("half"), (F.col("err_a") - F.col("err_b")).alias("g"))
    out = b.groupingSets([["domain"], ["half"], []], "domain", "half").agg(r6(F.avg("g")).alias("gain"), F.count("*").alias("k"))
    return out.select(F.coalesce("domain", F.lit("ALL")).alias("domain"), F.coalesce("half", F.lit("ALL")).alias("half"), "gain", "k")


@query(f"{ERR}, s AS (SELECT domain, sum(err_a - err_b) AS ab, sum(err_a - (err_b + err_c) / 2) AS ab2 FROM v_err GROUP BY 1) SELECT domain, round(ab2 / nullif(ab, 0) * 100, 4) AS retained, CASE WHEN ab2 / nullif(ab, 0) * 100 >= 60 THEN 'reasoning' WHEN ab2 / nullif(ab, 0) * 100 >= 25 THEN 'mixed' ELSE 'recognition' END AS verdict FROM s")
def lookahead_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = errors(spark, sf_dir).groupBy("domain").agg(F.sum(F.col("err_a") - F.col("err_b")).alias("ab"), F.sum(F.col("err_a") - (F.col("err_b") + F.col("err_c")) / 2).alias("ab2"))
    r = F.col("ab2") / F.nullif(F.col("ab"), F.lit(0.0)) * 100
    return s.select("domain", F.round(r, 4).alias("retained"), F.when(r >= 60, "reasoning").when(r >= 25, "mixed").otherwise("recognition").alias("verdict"))


@query(f"{ITEM}, a AS (SELECT dataset, future[5] > history[10] AS truth, CASE (month(origin) % 3) WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS said FROM v_g), s AS (SELECT dataset, avg((said IS NOT NULL)::INT) AS rate, avg((said = truth)::INT) FILTER (WHERE said IS NOT NULL) AS acc FROM a GROUP BY 1) SELECT dataset, round(rate, 6) AS rate, round(acc, 6) AS acc, CASE WHEN rate < 0.25 OR abs(acc - 0.5) < 0.15 THEN 'CLEAN' ELSE 'HAZARD' END AS verdict FROM s")
def lap_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.month("origin") % 3
    a = items(spark, sf_dir).select("dataset", (F.col("future")[4] > F.col("history")[9]).alias("truth"), F.when(m == 1, True).when(m == 2, False).alias("said"))
    s = a.groupBy("dataset").agg(F.avg(F.col("said").isNotNull().cast("int")).alias("rate"), F.avg((F.col("said") == F.col("truth")).cast("int")).alias("acc"))
    verdict = F.when((F.col("rate") < 0.25) | (F.abs(F.col("acc") - 0.5) < 0.15), "CLEAN").otherwise("HAZARD")
    return s.select("dataset", r6("rate").alias("rate"), r6("acc").alias("acc"), verdict.alias("verdict"))


STYLES = f"""{ITEM}, v_short AS (SELECT day, arg_min(title, {{'n': len(title), 'a': article_id}}) AS title FROM v_article GROUP BY 1)"""


@query(f"{STYLES} SELECT series_id, i.text = coalesce(s.title, '') AS same, CASE WHEN origin < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM v_item i LEFT JOIN v_short s ON i.kt = s.day")
def thin_rich_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in two styles of text, the latest article of a day and its shortest one, joined on what isn't style; one split for both."""
    rich = items(spark, sf_dir).select(F.concat("series_id", F.lit("_rich")).alias("rich_id"), "text")
    short = V.article(spark, sf_dir).groupBy("day").agg(F.min_by("title", F.struct(F.length("title"), "article_id")).alias("title"))
    thin = items(spark, sf_dir).drop("text").join(short, F.col("kt") == F.col("day"), "left").select(F.concat("series_id", F.lit("_thin")).alias("thin_id"), "origin", F.coalesce("title", F.lit("")).alias("title"))
    key = lambda c: F.regexp_replace(c, "_(thin|rich)$", "")
    both = thin.join(rich, key(thin["thin_id"]) == key(rich["rich_id"]))
    split = F.when(F.col("origin") < F.lit(CUT).cast("date"), "train").otherwise("test")
    return both.select(key(F.col("thin_id")).alias("series_id"), (F.col("text") == F.col("title")).alias("same"), split.alias("split"))


PLACED = f"{ITEM}, x AS (SELECT series_id, dataset, origin, list_transform(history, lambda v: round(v, -4)) AS own, list_transform(future, lambda v: round(v, -4)) AS said, row_number() OVER (PARTITION BY dataset ORDER BY series_id) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM v_g)"
FIT = "len(list_filter(a.said, lambda s: list_contains({0}.own, s))) / 5.0::DOUBLE"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = lambda c: F.transform(c, lambda v: F.round(v, -4))
    r = F.row_number().over(Window.partitionBy("dataset").orderBy("series_id")) - 1
    return items(spark, sf_dir).select("series_id", "dataset", "origin", place(F.col("history")).alias("own"), place(F.col("future")).alias("said"), r.alias("r"))


@query(f"{PLACED} SELECT a.series_id, round(max({FIT.format('a')}) - avg({FIT.format('b')}), 6) + 0.0 AS disc FROM (SELECT *, unnest(range(20)) AS j FROM x WHERE n >= 2) a JOIN x b ON a.dataset = b.dataset AND b.r = (a.r + 1 + (a.r * 7919 + a.j * 104729) % (a.n - 1)) % a.n GROUP BY 1")
def discriminability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own match rate less the mean over 20 drawn series of the same dataset."""
    x = placed(spark, sf_dir)
    return E.distinct_from(x, x.select("dataset", "r", "own"), "dataset", others=True).select("series_id", (r6("disc") + 0.0).alias("disc"))


HELD = f"""{PLACED}, y AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY origin) AS t FROM x WHERE n >= 10), s AS (SELECT *, t <= floor(n * 0.8) AS train FROM y),
p AS (SELECT dataset, own, row_number() OVER (PARTITION BY dataset ORDER BY series_id) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS m FROM s WHERE train), q AS (SELECT *, unnest(range(20)) AS j FROM s WHERE NOT train),
v_held AS (SELECT a.series_id, a.dataset, max({FIT.format('a')}) - avg({FIT.format('b')}) AS disc FROM q a JOIN p b ON a.dataset = b.dataset AND b.r = (a.r * 7919 + a.j * 104729) % b.m GROUP BY ALL)"""


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    x = placed(spark, sf_dir)
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("dataset"))).where("n >= 10").drop("n")
    s = E.chronological(x, "dataset", "origin", 0.8)
    train = s.where("split = 'train'").withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy("series_id")) - 1)
    return E.distinct_from(s.where("split = 'test'"), train.select("dataset", "r", "own"), "dataset", others=False)


@query(f"{HELD} SELECT series_id, round(disc, 6) + 0.0 AS disc FROM v_held")
def discriminability_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of a dataset against series drawn from the first four."""
    return held_out(spark, sf_dir).select("series_id", (r6("disc") + 0.0).alias("disc"))


@query(f"{HELD} SELECT dataset, count(*) AS n, round(median(disc), 6) + 0.0 AS held_out FROM v_held GROUP BY 1")
def heldout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"), (r6(F.median("disc")) + 0.0).alias("held_out"))


TF = """WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents),
tf AS (SELECT source, term, count(*) AS tf FROM w WHERE term NOT IN ('the', 'and') GROUP BY ALL), n AS (SELECT count(DISTINCT source) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT source, term, tf * (ln(n / df) + 1) AS w FROM tf JOIN df USING (term), n),
l AS (SELECT source, sqrt(sum(w * w)) AS l FROM x GROUP BY 1), v AS (SELECT source, term, w / l AS weight FROM x JOIN l USING (source))"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("source", "text")
    return E.tfidf(d, "source", "text", ("the", "and"))


@query(TF + " SELECT source, count(*) AS terms, round(max(weight), 6) AS top FROM v GROUP BY 1")
def tfidf_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).groupBy("source").agg(F.count("*").alias("terms"), r6(F.max("weight")).alias("top"))


@query(TF + " SELECT a.source AS a, b.source AS b, round(sum(a.weight * b.weight), 6) AS cosine, sum(a.weight * b.weight) > 0.5 AS flagged FROM v a JOIN v b ON a.term = b.term AND a.source < b.source GROUP BY ALL")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.cosines(weights(spark, sf_dir), "source")
    return c.select("a", "b", r6("cosine").alias("cosine"), (F.col("cosine") > 0.5).alias("flagged"))


QUERIES, ORACLES = query.queries, query.oracles
