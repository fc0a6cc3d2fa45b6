"""Forecasts of text-reading models, from caches alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import series as S


def cache_key(text: Column, history: Column, horizon: int) -> Column:
    """What an answer is kept by: text, history to three places, and horizon."""
    values = F.array_join(F.transform(history, lambda v: F.round(v, 3).cast("string")), ", ")
    return F.substring(F.sha1(F.concat(text, F.lit("|["), values, F.lit(f"]|{horizon}"))), 1, 16)


def parsed(answer: Column, horizon: int) -> Column:
    """The first numbers of an answer; none without one."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"-?\d+\.?\d*"), F.lit(0))
    return F.slice(F.transform(found, lambda x: x.cast("double")), 1, horizon)


def filled(numbers: Column, history: Column, horizon: int) -> Column:
    return F.slice(F.concat(numbers, S.last_value(history, horizon)), 1, horizon)


class TextForecasterStub:
    """Stands where a model that reads text would: it never makes a forecast up."""

    name, uses_text = "stub", True

    def predict(self, history: Column, text: Column, horizon: int) -> Column:
        raise NotImplementedError("no text-reading model here: use cached forecasts")


def features(values: Column, recent: Column, text: Column) -> dict[str, Column]:
    """Spread, recency, population deviation, words."""
    return {"spike_pt": F.array_max(values) - F.array_min(values), "recency": recent.cast("int"), "series_std": S.std(values), "text_words": F.size(F.split(F.trim(text), r"\s+"))}
