"""Brier scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import steady_mean


def brier(p: str, y: str = "resolved_to") -> Column:
    return F.pow(F.col(p) - F.col(y), 2)


def bucket(horizon: Column) -> Column:
    return F.when(horizon <= 7, "<=7").when(horizon <= 30, "<=30").when(horizon <= 90, "<=90").otherwise(">90")


def p_up(quantiles: Column, levels: Sequence[float], last: Column) -> Column:
    """Probability of ending above ``last``: one less the interpolated distribution, 0.9 or 0.1 outside the quantiles."""
    out = F.when(last <= quantiles[0], 0.9).when(last >= quantiles[len(levels) - 1], 0.1)
    for i in range(1, len(levels)):
        lo, hi = quantiles[i - 1], quantiles[i]
        out = out.when(last <= hi, 1 - (levels[i - 1] + (levels[i] - levels[i - 1]) * (last - lo) / (hi - lo)))
    return out


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end)."""
    return F.size(F.filter(F.sequence(start, F.date_sub(end, 1)), lambda d: F.weekday(d) < 5))


def leaderboard(scored: DataFrame, least: int) -> DataFrame:
    """model, n, b, f (FRED), y (Yahoo), rank, of models with ``least`` points. Ranks need one order: a row for each model.

    Models of equal scores have equal means, whatever the order of their rows, so their names decide.
    """
    b = F.pow(F.col("forecast") - F.col("resolved_to"), 2)
    g = scored.groupBy("model").agg(F.count("*").alias("n"), steady_mean(b).alias("b"), steady_mean(F.when(F.col("domain") == "fred", b)).alias("f"), steady_mean(F.when(F.col("domain") == "yahoo", b)).alias("y"))
    return g.where(F.col("n") >= least).withColumn("rank", F.row_number().over(Window.orderBy("b", "model")))


def domain_label(domain: Column) -> Column:
    return F.when(domain == "fred", "fred").otherwise("yfinance")
