"""Salient-move detection over daily segment prices and hourly event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..plans import views as V
from .common import Registry, r6

query = Registry()

RET = V.PRICE + """, v_ret AS (
  SELECT series_id, idx, k, price / before - 1 AS ret FROM (
    SELECT p.*, s.k, lag(price, s.k) OVER (PARTITION BY series_id, s.k ORDER BY idx) AS before
    FROM v_price p CROSS JOIN (VALUES (1), (3), (5)) s(k)) WHERE before <> 0)"""

PARAMS = RET + """, v_med AS (SELECT series_id, k, median(ret) AS med FROM v_ret GROUP BY ALL),
v_mad AS (SELECT r.series_id, r.k, any_value(med) AS med, median(abs(ret - med)) AS mad0 FROM v_ret r JOIN v_med USING (series_id, k) GROUP BY ALL),
v_par AS (SELECT series_id, k, med, CASE WHEN mad0 = 0 THEN 1e-9 ELSE mad0 END AS mad FROM v_mad),
v_z AS (SELECT series_id, idx, r.k, ret, 0.6745 * (ret - med) / mad AS z FROM v_ret r JOIN v_par USING (series_id, k))"""


def fold(source: str, key: str, rank: str, spacing: int, top: int = 1_000_000) -> str:
    """A recursive CTE v_fold(key, idxs) that takes candidates in order, ``spacing`` apart."""
    return f"""v_ord AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {rank}) AS rn FROM {source}),
v_fold AS (
  SELECT {key}, 1 AS rn, [idx]::BIGINT[] AS acc, [1]::BIGINT[] AS took FROM v_ord WHERE rn = 1
  UNION ALL
  SELECT o.{key}, o.rn::INT,
    CASE WHEN len(f.acc) < {top} AND len(list_filter(f.acc, lambda j: abs(j - o.idx) < {spacing})) = 0 THEN list_append(f.acc, o.idx) ELSE f.acc END,
    CASE WHEN len(f.acc) < {top} AND len(list_filter(f.acc, lambda j: abs(j - o.idx) < {spacing})) = 0 THEN list_append(f.took, o.rn) ELSE f.took END
  FROM v_fold f JOIN v_ord o ON o.{key} = f.{key} AND o.rn = f.rn + 1),
v_took AS (SELECT o.* FROM v_ord o JOIN (SELECT {key}, max_by(took, rn) AS took FROM v_fold GROUP BY ALL) t ON o.{key} = t.{key} AND list_contains(t.took, o.rn))"""


@query(f"WITH {RET} SELECT series_id, idx, k, round(ret, 6) AS ret FROM v_ret")
def k_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.returns(V.price(spark, sf_dir), (1, 3, 5)).select("series_id", "idx", "k", r6("ret").alias("ret"))


@query(f"WITH {PARAMS} SELECT series_id, k, round(med, 6) AS med, round(mad, 6) AS mad FROM v_par")
def robust_z_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.robust_params(D.returns(V.price(spark, sf_dir), (1, 3, 5)), "ret", "series_id", "k").select("series_id", "k", r6("med").alias("med"), r6("mad").alias("mad"))


@query(f"WITH RECURSIVE {RET}, v_hit AS (SELECT * FROM v_ret WHERE k = 1 AND abs(ret) >= 1.5), {fold('v_hit', 'series_id', '-abs(ret), idx', 10, 8)} SELECT series_id, idx, k, round(ret, 6) AS ret FROM v_took")
def det_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_threshold(V.price(spark, sf_dir), 1.5, 10, 8).select("series_id", "idx", "k", r6("ret").alias("ret"))


@query(f"WITH RECURSIVE {RET}, v_hit AS (SELECT * FROM v_ret WHERE k = 1 AND abs(ret) >= 2.0), {fold('v_hit', 'series_id', '-abs(ret), idx', 21, 5)} SELECT series_id, idx, round(ret, 6) AS ret FROM v_took")
def det_oil_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_threshold(V.price(spark, sf_dir), 2.0, 21, 5).select("series_id", "idx", r6("ret").alias("ret"))


MULTI = f"{PARAMS}, v_hit AS (SELECT * FROM v_z WHERE abs(z) >= 2.8), {fold('v_hit', 'series_id', '-abs(z), k, idx', 10)}"


@query(f"WITH RECURSIVE {MULTI} SELECT series_id, idx, k, round(ret, 6) AS ret, round(z, 6) AS z FROM v_took")
def det_multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_multiscale(V.price(spark, sf_dir)).select("series_id", "idx", "k", r6("ret").alias("ret"), r6("z").alias("z"))


@query(f"WITH RECURSIVE {PARAMS}, v_hit AS (SELECT * FROM v_z WHERE abs(z) >= 4), {fold('v_hit', 'series_id', '-abs(z), k, idx', 21)} SELECT series_id, idx, k, round(ret, 4) AS ret, round(z, 4) AS z FROM v_took")
def det_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_multiscale(V.price(spark, sf_dir), z_min=4.0, spacing=21).select("series_id", "idx", "k", F.round("ret", 4).alias("ret"), F.round("z", 4).alias("z"))


LEVEL = V.VIEWS + """, v_m AS (SELECT entity, median(v) AS med FROM v_views GROUP BY 1),
v_d AS (SELECT entity, any_value(med) AS med, median(abs(v - med)) AS mad FROM v_views JOIN v_m USING (entity) GROUP BY 1),
v_lz AS (SELECT entity, idx, v, 0.6745 * (v - med) / CASE WHEN mad = 0 THEN 1e-9 ELSE mad END AS z FROM v_views JOIN v_d USING (entity))"""


@query(f"WITH {LEVEL} SELECT entity, idx, round(z, 6) AS z FROM v_lz")
def mad_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.robust_z(V.views(spark, sf_dir).select("entity", "idx", "v"), "v", "entity").select("entity", "idx", r6("z").alias("z"))


@query(f"""WITH {V.VIEWS}, top AS (SELECT entity, arg_min(idx, struct_pack(a := -v, b := idx)) AS peak_idx, max(v) AS peak, count(*) AS n FROM v_views GROUP BY 1),
pre AS (SELECT v.entity, median(v.v) AS before FROM v_views v JOIN top t ON v.entity = t.entity AND v.idx < t.peak_idx GROUP BY 1)
SELECT entity, peak_idx, peak, before, CASE WHEN n <= 10 THEN 'series_too_short' WHEN peak_idx < 10 THEN 'no_pre_event_state'
  WHEN peak / CASE WHEN before = 0 THEN 1e-9 ELSE before END < 1.8 THEN 'no_clear_spike' END AS reason FROM top LEFT JOIN pre USING (entity)""")
def det_single_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.single_peak(V.views(spark, sf_dir), "entity", "v", ratio=1.8)


PEAKS = f"{LEVEL}, v_hit AS (SELECT * FROM v_lz WHERE z >= 2), {fold('v_hit', 'entity', '-z, idx', 21)}"


@query(f"WITH RECURSIVE {PEAKS} SELECT entity, idx, v, round(z, 6) AS z FROM v_took")
def det_multi_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.multi_peak(V.views(spark, sf_dir), "entity", "v", 2.0).select("entity", "idx", "v", r6("z").alias("z"))


@query(f"WITH RECURSIVE {PEAKS} SELECT entity, idx, v FROM v_took QUALIFY row_number() OVER (PARTITION BY entity ORDER BY idx) <= 3")
def peak_cap_chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_by_date(D.multi_peak(V.views(spark, sf_dir), "entity", "v", 2.0), "entity", 3).select("entity", "idx", "v")


@query(f"WITH {V.PRICE} SELECT series_id, date_trunc('month', dt)::DATE AS month, round(avg(price), 6) AS mean, coalesce(stddev_pop(price) < 1e-3 * greatest(abs(avg(price)), 1), false) AS flat FROM v_price GROUP BY ALL")
def flat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.price(spark, sf_dir).groupBy("series_id", F.trunc("dt", "month").alias("month")).agg(F.avg("price").alias("m"), F.stddev_pop("price").alias("s"))
    return g.select("series_id", "month", r6("m").alias("mean"), D.flat_context(F.col("m"), F.col("s")).alias("flat"))


@query(f"""WITH RECURSIVE {PARAMS}, v_hit AS (SELECT * FROM v_z WHERE abs(z) >= 2.8), {fold('v_hit', 'series_id', '-abs(z), k, idx', 10)},
t_hit AS (SELECT * FROM v_ret WHERE k = 1 AND abs(ret) >= 1.5), {fold('t_hit', 'series_id', '-abs(ret), idx', 10, 8).replace('v_ord', 't_ord').replace('v_fold', 't_fold').replace('v_took', 't_took')}
SELECT t.series_id, count(*) AS hits,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_took m WHERE m.series_id = t.series_id AND abs(m.idx - t.idx) < 10)) AS covered,
  (SELECT count(*) FROM v_took m WHERE m.series_id = t.series_id AND NOT EXISTS (SELECT 1 FROM t_took x WHERE x.series_id = m.series_id AND abs(m.idx - x.idx) < 10)) AS recovered
FROM t_took t GROUP BY t.series_id""")
def det_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.price(spark, sf_dir)
    return D.coverage(D.detect_threshold(p, 1.5, 10, 8), D.detect_multiscale(p))


QUERIES, ORACLES = query.queries, query.oracles
