"""From daily prices to forecast pairs: salient moves, the text known before them, windows, normalising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import detect as D
from ..operators import retrieve as R
from . import views as V


def pairs(spark: SparkSession, sf_dir: str, history: int = 10, future: int = 5) -> DataFrame:
    """series_id, idx, k, kt, n_texts, first_z, target_z, reason: a row for each salient move."""
    p = V.price(spark, sf_dir)
    moves = D.detect_multiscale(p)
    w = Window.partitionBy("series_id").orderBy("idx")
    windows = p.withColumns({"h": F.collect_list("price").over(w.rowsBetween(-history, -1)), "f": F.collect_list("price").over(w.rowsBetween(0, future - 1))})
    events = moves.join(windows.select("series_id", "idx", "dt", "h", "f"), ["series_id", "idx"])
    events = events.withColumn("event_id", F.concat_ws("_", "series_id", F.col("idx").cast("string"))).withColumn("day", F.col("dt"))
    heads = R.headlines(V.article(spark, sf_dir), F.length("title"))
    found = R.top_matches(R.interval_matches(events.select("event_id", "day"), heads, 4), 8)
    known = found.groupBy("event_id").agg(F.count("*").alias("n_texts"), F.max("day").alias("kt"))
    out = events.join(known, "event_id", "left").withColumn("m", S.mean(F.col("h"))).withColumn("s", S.std_floor(F.col("m"), S.std(F.col("h"))))
    reason = F.when((F.size("h") < history) | (F.size("f") < future), "insufficient_history_or_horizon").when(F.col("kt").isNull(), "no_text").when(F.col("kt") >= F.col("dt"), "leak").otherwise("emitted")
    z = lambda v: F.round((v - F.col("m")) / F.col("s"), 5)
    return out.select("series_id", "idx", "k", "kt", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), z(F.get("h", F.lit(0))).alias("first_z"), z(F.get("f", F.lit(0))).alias("target_z"), reason.alias("reason"))


def sql() -> str:
    """The same rows as SQL."""
    from ..queries.detection import MULTI

    return f"""WITH RECURSIVE {MULTI}, {V.ARTICLE},
v_point AS (SELECT *, list(price) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h, list(price) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS f FROM v_price),
v_ev AS (SELECT t.series_id, t.idx, t.k, p.dt, p.h, p.f FROM v_took t JOIN v_point p ON t.series_id = p.series_id AND t.idx = p.idx),
v_head AS (SELECT article_id, day, md5(lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g'))) AS nt, len(title) AS score FROM v_article),
v_m AS (SELECT e.series_id, e.idx, a.* FROM v_ev e JOIN v_head a ON a.day >= e.dt - 4 AND a.day < e.dt QUALIFY row_number() OVER (PARTITION BY e.series_id, e.idx, nt ORDER BY article_id) = 1),
v_top AS (SELECT * FROM v_m QUALIFY row_number() OVER (PARTITION BY series_id, idx ORDER BY score DESC, day DESC, article_id) <= 8),
v_known AS (SELECT series_id, idx, count(*) AS n_texts, max(day) AS kt FROM v_top GROUP BY ALL),
v_all AS (SELECT e.*, kt, coalesce(n_texts, 0) AS n_texts, list_avg(h) AS m FROM v_ev e LEFT JOIN v_known n ON e.series_id = n.series_id AND e.idx = n.idx),
v_dev AS (SELECT *, greatest(sqrt(list_avg(list_transform(h, lambda x: pow(x - m, 2)))), 1e-3 * greatest(abs(m), 1)) AS s FROM v_all)
SELECT series_id, idx, k, kt, n_texts, round((h[1] - m) / s, 5) AS first_z, round((f[1] - m) / s, 5) AS target_z,
  CASE WHEN len(h) < 10 OR len(f) < 5 THEN 'insufficient_history_or_horizon' WHEN kt IS NULL THEN 'no_text' WHEN kt >= dt THEN 'leak' ELSE 'emitted' END AS reason FROM v_dev"""
