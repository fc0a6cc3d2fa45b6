"""Numeric array functions: normalising, forecasts, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def steady_mean(x: Column) -> Column:
    """Mean of a group (aggregate) that the order in which rows meet doesn't change, so equal groups have equal means.

    Values are summed as decimals of 18 places; where one doesn't fit (1e10 or more, NaN, infinite), it is the plain mean.
    """
    exact = x.try_cast("decimal(28,18)")
    return F.when(F.count(exact) == F.count(x), F.try_divide(F.sum(exact).cast("double"), F.count(x))).otherwise(F.avg(x))


def std(values: Column) -> Column:
    """Population standard deviation."""
    m = mean(values)
    return F.sqrt(F.aggregate(F.transform(values, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x) / F.size(values))


def std_floor(m: Column, s: Column) -> Column:
    return F.greatest(s, 1e-3 * F.greatest(F.abs(m), F.lit(1.0)))


def finite(values: Column) -> Column:
    """Not empty, and without nulls, NaN and infinities."""
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def last_value(history: Column, n: int) -> Column:
    return F.array_repeat(F.element_at(history, -1), n)


def linear_trend(history: Column, n: int) -> Column:
    """Least squares over 0.., carried on for n steps; a single point has slope 0."""
    size = F.size(history).cast("double")
    mx, my = (size - 1) / 2, mean(history)
    at = F.transform(history, lambda x, i: (i - mx) * (x - my))
    over = F.aggregate(F.transform(history, lambda x, i: (i - mx) * (i - mx)), F.lit(0.0), lambda a, x: a + x)
    slope = total(at) / F.when(over == 0, 1.0).otherwise(over)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: my + slope * (size + h - mx))


def mase(forecast: Column, future: Column, history: Column, floor: float = 1e-6, replace_zero: bool = True) -> Column:
    """Mean absolute error over the mean step of the history; the step is floored (or only a step of 0 replaced)."""
    mae = total(F.zip_with(forecast, future, lambda a, b: F.abs(a - b))) / F.size(future)
    steps = F.zip_with(F.slice(history, 2, F.size(history) - 1), F.slice(history, 1, F.size(history) - 1), lambda a, b: F.abs(a - b))
    step = total(steps) / (F.size(history) - 1)
    return mae / (F.when(step == 0, floor).otherwise(step) if replace_zero else F.greatest(step, F.lit(floor)))


def sparkline(values: Column) -> Column:
    """Eight levels of blocks, by place between the least and the most."""
    lo, hi = F.array_min(values), F.array_max(values)
    blocks = F.array(*(F.lit(b) for b in "▁▂▃▄▅▆▇█"))
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    return F.array_join(F.transform(values, lambda v: F.element_at(blocks, F.floor((v - lo) / span * 7.999).cast("int") + 1)), "")


def general(x: Column) -> Column:
    """A number in six significant digits without trailing zeros, as %.6g writes it; ties of its decimal digits go up."""
    short = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    parts = F.split(F.format_string("%.5e", x), "e")
    power = parts[1].cast("int")
    out = F.concat(short(parts[0]), F.lit("e"), parts[1])
    for k in range(-4, 6):
        out = F.when(power == k, short(F.format_string(f"%.{5 - k}f", x)) if k < 5 else F.format_string("%.0f", x)).otherwise(out)
    return out
