"""Salient moves: returns over several scales, robust scores, and greedy spacing.

Everything up to the greedy choice is windows and grouped medians by series. The choice itself depends
on what was chosen before, but only on what is near: it goes in rounds over short stretches of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Spacings that a unit of the greedy choice is wide.
WIDTH = 512


def returns(series: DataFrame, scales: Sequence[int]) -> DataFrame:
    """series_id, idx, k, ret: the change over k points for each scale, from one sort; none where the earlier price is 0."""
    w = Window.partitionBy("series_id").orderBy("idx")
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lag("price", k).over(w).alias("before")) for k in scales))
    out = series.select("series_id", "idx", "price", each.alias("each")).select("series_id", "idx", "price", F.explode("each").alias("x")).where("x.before <> 0")
    return out.select("series_id", "idx", "x.k", (F.col("price") / F.col("x.before") - 1).alias("ret"))


def k_returns(series: DataFrame, k: int) -> DataFrame:
    return returns(series, [k])


def robust_params(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, med, mad: median and median absolute deviation, 1e-9 instead of 0."""
    med = rows.groupBy(*keys).agg(F.median(value).alias("med"))
    mad = rows.join(med, list(keys)).groupBy(*keys).agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return mad.withColumn("mad", F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")))


def robust_z(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """rows with z = 0.6745 (value - median) / MAD by keys."""
    params = robust_params(rows, value, *keys)
    return rows.join(params, list(keys)).withColumn("z", 0.6745 * (F.col(value) - F.col("med")) / F.col("mad")).drop("med", "mad")


def _settled(table: pa.Table, key: str, names: list[str], spacing: int) -> pa.Table:
    """Own rows of a unit with the status they can be given: taken if no better candidate near may still be, out if a taken one is near."""
    idx, status = table["idx"].to_numpy(), table["status_"].to_numpy().copy()
    own = table["home_"].to_numpy() == table["unit_"].to_numpy()
    place = np.argsort(idx, kind="stable")
    at = np.empty(len(idx), np.int64)
    at[place] = np.arange(len(idx))
    low, high = np.searchsorted(idx[place], idx - spacing, "right"), np.searchsorted(idx[place], idx + spacing, "left")
    state = status[place]  # by idx; 0 open, 1 taken, 2 out
    seen = np.zeros(len(idx), bool)  # open ones that came before by rank
    for i in np.lexsort([table[n].to_numpy() for n in reversed(names)]):
        near, p = slice(low[i], high[i]), at[i]
        if state[p] == 0:
            others = state[near] == 1
            if others.any():
                state[p] = 2
            elif own[i] and not seen[near].any():
                state[p] = 1
            else:
                seen[p] = True
    status = state[at]
    out = table.set_column(table.column_names.index("status_"), "status_", pa.array(status, pa.int32()))
    return out.filter(pa.array(own)).drop_columns(["unit_", "home_"])


def spaced(candidates: DataFrame, key: str, rank: Sequence[Column], spacing: int, top: int | None = None, width: int = WIDTH) -> DataFrame:
    """Of each key's candidates (with idx), in order of rank, those at least ``spacing`` from all taken; ``top`` at most.

    A key is cut into units of ``width`` spacings, which see the candidates just beyond their ends. In each round a unit
    takes what no better open candidate is near to, and drops what is near to a taken one; what depends on
    another unit stays open until that has decided. Almost all is decided in two rounds; a round is a written table.
    """
    spark = candidates.sparkSession
    names = [f"r{i}_" for i in range(len(rank))]
    rows = candidates.withColumns({n: r.cast("double") for n, r in zip(names, rank)}).withColumn("status_", F.lit(0))
    rows = rows.where(F.col("idx").isNotNull())
    schema = rows.schema
    unit = lambda c: F.floor(c / (width * spacing)).cast("long")
    while True:
        units = rows.withColumn("home_", unit(F.col("idx")))
        units = units.withColumn("unit_", F.explode(F.array_distinct(F.array(unit(F.col("idx") - spacing), F.col("home_"), unit(F.col("idx") + spacing)))))
        path = scratch(spark, "spaced")
        units.groupBy(key, "unit_").applyInArrow(lambda t: _settled(t, key, names, spacing), schema).write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        if rows.where("status_ = 0").isEmpty():
            break
    taken = rows.where("status_ = 1")
    if top is not None:
        taken = taken.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*names))).where(F.col("n_") <= top)
    return taken.select(*candidates.columns)


def detect_threshold(series: DataFrame, least: float, spacing: int = 10, top: int = 8) -> DataFrame:
    """Moves over one point of ``least`` or more."""
    hits = k_returns(series, 1).where(F.abs("ret") >= least)
    return spaced(hits, "series_id", [-F.abs("ret"), F.col("idx")], spacing, top)


def detect_multiscale(series: DataFrame, scales: Sequence[int] = (1, 3, 5), z_min: float = 2.8, spacing: int = 10, top: int | None = None) -> DataFrame:
    """Moves over any scale with a robust score of z_min; one for each neighbourhood, with its strongest scale."""
    z = robust_z(returns(series, scales), "ret", "series_id", "k").where(F.abs("z") >= z_min)
    return spaced(z, "series_id", [-F.abs("z"), F.array_position(F.array(*(F.lit(s) for s in scales)), F.col("k")), F.col("idx")], spacing, top)


def single_peak(series: DataFrame, key: str, value: str, least_before: int = 10, ratio: float = 3.0) -> DataFrame:
    """key, peak_idx, peak, before (median), reason: the first maximum, if it stands out from what was before."""
    top = series.groupBy(key).agg(F.min_by("idx", F.struct(-F.col(value), F.col("idx"))).alias("peak_idx"), F.max(value).alias("peak"), F.count("*").alias("n"))
    pre = series.join(top, key).where("idx < peak_idx").groupBy(key).agg(F.median(value).alias("before"))
    out = top.join(pre, key, "left")
    base = F.when(F.col("before") == 0, 1e-9).otherwise(F.col("before"))
    reason = F.when(F.col("n") <= least_before, "series_too_short").when(F.col("peak_idx") < least_before, "no_pre_event_state").when(F.col("peak") / base < ratio, "no_clear_spike")
    return out.select(key, "peak_idx", "peak", "before", reason.alias("reason"))


def multi_peak(series: DataFrame, key: str, value: str, z_min: float = 4.0, spacing: int = 21) -> DataFrame:
    """Levels with a robust score of z_min or more, spaced."""
    z = robust_z(series.select(key, "idx", value), value, key).where(F.col("z") >= z_min)
    return spaced(z, key, [-F.col("z"), F.col("idx")], spacing)


def first_by_date(peaks: DataFrame, key: str, n: int = 8) -> DataFrame:
    return peaks.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("idx"))).where(F.col("r") <= n).drop("r")


def coverage(threshold: DataFrame, multiscale: DataFrame, near: int = 10) -> DataFrame:
    """series_id, hits, covered, recovered: threshold moves that a multiscale move is near to, and multiscale moves far from all."""
    t, m = threshold.select("series_id", F.col("idx").alias("i")), multiscale.select(F.col("series_id").alias("s"), F.col("idx").alias("j"))
    close = (F.col("series_id") == F.col("s")) & (F.abs(F.col("i") - F.col("j")) < near)
    covered = t.join(m, close, "left_semi").groupBy("series_id").agg(F.count("*").alias("covered"))
    recovered = m.join(t, close, "left_anti").groupBy(F.col("s").alias("series_id")).agg(F.count("*").alias("recovered"))
    hits = t.groupBy("series_id").agg(F.count("*").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return hits.join(covered, "series_id", "left").join(recovered, "series_id", "left").select("series_id", "hits", zero("covered"), zero("recovered"))


def flat_context(mean: Column, std: Column) -> Column:
    """Whether a history varies too little to say anything."""
    return std < 1e-3 * F.greatest(F.abs(mean), F.lit(1.0))
