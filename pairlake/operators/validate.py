"""Structural checks: a record in, an array of error codes out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import finite

# Allowed words and the grammar of frequencies.
ROLES = ("context", "target", "observed", "covariate")
QUALITIES = {"cpt": ("real", "generated"), "chatml": ("real", "derived", "generated", "derived_generated", "template")}
FREQUENCY = r"^(\d+)(ms|s|m|h|d|w|W|M|q|y|over|play|prd)$"
SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "W": 604800, "M": 2629800, "q": 7889400, "y": 31557600}


def codes(*checks: tuple[Column, str]) -> Column:
    """The codes whose condition holds; a null condition doesn't."""
    return F.array_compact(F.array(*(F.when(c, k) for c, k in checks)))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<ts></ts>"))


def example_errors(kind: Column, text: Column, history: Column, future: Column) -> Column:
    """A pair before it is written out."""
    described, forecast = kind == "ts_to_text", kind == "text_to_ts"
    return codes(
        (described & (F.coalesce(F.length(text), F.lit(0)) == 0), "answer_missing"),
        (described & ~finite(history), "series_invalid"),
        (forecast & (~finite(history) | (F.size(history) < 2)), "history_invalid"),
        (forecast & ~finite(future), "future_invalid"),
        (~described & ~forecast, "kind_unknown"),
    )


def chatml_errors() -> Column:
    """Records with text, task_type, timeseries (len, role, values, loss_start), ranges, num_spans."""
    ts, n = F.col("timeseries"), F.size("timeseries")
    text = F.coalesce(F.col("text"), F.lit(""))
    forecast = F.coalesce(F.startswith("task_type", F.lit("ts_forecast")), F.lit(False))
    target = F.filter(ts, lambda s: s["role"] == "target")
    context = F.filter(ts, lambda s: s["role"] == "context")
    h = F.get(context, F.lit(0))["len"]
    bad = lambda f: F.exists(ts, f)
    return codes(
        (text == "", "text_missing"),
        (n <= 0, "timeseries_missing"),
        (tokens(text) != n, "ts_token_count"),
        (bad(lambda s: F.coalesce(F.size(s["values"]), F.lit(0)) <= 0), "empty_values"),
        (bad(lambda s: (F.size(s["values"]) > 0) & (F.size(s["values"]) != s["len"])), "span_len"),
        (bad(lambda s: (F.size(s["values"]) > 0) & ~finite(s["values"])), "non_finite"),
        (bad(lambda s: ~F.coalesce(s["role"].isin(*ROLES), F.lit(False))), "role"),
        (bad(lambda s: F.coalesce((s["loss_start"] < 0) | (s["loss_start"] > F.size(s["values"])), F.lit(True))), "loss_start"),
        (forecast & (F.size(target) == 0), "target_missing"),
        (forecast & (F.slice(F.get(target, F.lit(0))["values"], 1, F.greatest(h, F.lit(0))) != F.get(context, F.lit(0))["values"]), "target_prefix"),
        (forecast & (F.get(target, F.lit(0))["loss_start"] != h), "target_loss_start"),
        (F.col("ranges").isNull(), "ranges_missing"),
        ((F.col("task_type") == "text_desc") & (F.size("ranges") == 0), "ranges_empty"),
        (forecast & (F.size("ranges") > 0), "ranges_not_empty"),
        (F.exists("ranges", lambda x: (F.size(x) != 2) | (x[0] < 0) | (x[0] >= x[1]) | (x[1] > F.length(text))), "range_bounds"),
        (~F.coalesce(F.col("num_spans") == n, F.lit(False)), "normalization"),
    )


def format_of(text: Column, spans: Column, task: Column) -> Column:
    roles = F.coalesce(F.get(spans, F.lit(0))["role"].isNotNull(), F.lit(False))
    return F.when(F.contains(text, F.lit("<|im_start|>")) | roles, "chatml").when(task == "world_knowledge", "cpt").when(F.size(spans) > 0, "cpt").otherwise("unknown")


def channel_checks(text: Column, freq: Column, values: Column, days: Column, least: int) -> Column:
    """Codes of a pretraining record with one channel."""
    count, unit = F.regexp_extract(freq, FREQUENCY, 1), F.regexp_extract(freq, FREQUENCY, 2)
    seconds = F.element_at(F.create_map(*(x for k, v in SECONDS.items() for x in (F.lit(k), F.lit(v)))), unit)
    implied = count.try_cast("int") * seconds * (F.size(values) - 1) / 86400.0
    ratio = days / F.nullif(implied, F.lit(0.0))
    return codes(
        (F.coalesce(F.length(text), F.lit(0)) == 0, "text_missing"),
        (tokens(text) != 1, "ts_token_count"),
        (~freq.rlike(FREQUENCY), "bad_freq"),
        (F.size(values) == 1, "single_point_series"),
        ((F.size(values) > 1) & (F.size(values) < least), "short_series"),
        ((days >= 2) & (F.size(values) >= 2) & ((ratio > 50) | (ratio < 1 / 50)), "freq_period_mismatch"),
    )


def recites(values: Column, found: Column) -> Column:
    """Whether a number of the text is within 1 % (0.01 at least) of a value, as it is or rounded."""
    near = lambda v, t: F.abs(t - v) <= F.greatest(0.01 * F.abs(v), F.lit(0.01))
    return F.exists(values, lambda v: F.exists(found, lambda t: near(v, t) | near(F.round(v, 1), t) | near(F.round(v, 2), t) | near(F.round(v, 0), t)))


def pretraining_errors(task: Column, text: Column, channels: Column) -> Column:
    """The gate of pretraining records as they go out."""
    return codes((~F.coalesce(task == "world_knowledge", F.lit(False)), "task_type"), (F.coalesce(channels, F.lit(0)) <= 0, "timeseries_missing"), (tokens(F.coalesce(text, F.lit(""))) != channels, "placeholder_count"))


def output_errors(records: dict[str, DataFrame], key: str) -> DataFrame:
    """key, format, errors (all codes) of records by format, each in the schema of its format.

    chatml: text, task_type, timeseries, ranges, num_spans. cpt: text, task_type, channels. ir: kind, text,
    history, future. Records of any other format have the one error unknown_format.
    """
    gates = {
        "chatml": chatml_errors,
        "cpt": lambda: pretraining_errors(F.col("task_type"), F.col("text"), F.col("channels")),
        "ir": lambda: example_errors(F.col("kind"), F.col("text"), F.col("history"), F.col("future")),
    }
    unknown = lambda: F.array(F.lit("unknown_format"))
    return reduce(DataFrame.unionByName, (df.select(key, F.lit(name).alias("format"), gates.get(name, unknown)().alias("errors")) for name, df in records.items()))


def forecast_errors(knowledge_time: bool = False) -> Column:
    """Forecast records (text, task_type, timeseries, ranges, kt) by the rules again: one context, one target, nothing else."""
    ts = F.col("timeseries")
    of = lambda role: F.filter(ts, lambda s: s["role"] == role)
    context, target = F.get(of("context"), F.lit(0)), F.get(of("target"), F.lit(0))
    some = lambda f: F.exists(ts, f)
    h = context["len"]
    return codes(
        (tokens(F.coalesce(F.col("text"), F.lit(""))) != F.size(ts), "placeholder_count"),
        (some(lambda s: F.size(s["values"]) != s["len"]), "span_len"),
        (some(lambda s: ~finite(s["values"])), "non_finite"),
        (some(lambda s: (s["loss_start"] < 0) | (s["loss_start"] > s["len"])), "loss_range"),
        (~F.coalesce(F.startswith("task_type", F.lit("ts_forecast")), F.lit(False)), "task_type"),
        (F.size(of("target")) != 1, "one_target"),
        (F.size(of("context")) != 1, "one_context"),
        (F.slice(target["values"], 1, h) != context["values"], "target_prefix"),
        ((target["loss_start"] != h) | (context["loss_start"] != h), "loss_start"),
        (F.coalesce(F.size("ranges"), F.lit(-1)) != 0, "ranges_not_empty"),
        *([(F.col("kt").isNull(), "missing_knowledge_time")] if knowledge_time else []),
    )
