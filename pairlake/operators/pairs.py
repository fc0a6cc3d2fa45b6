"""Pairs of text and series: records, conversions between formats, and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S

# Markers of the record formats.
TS, USER, ASSISTANT, END = "<ts></ts>", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>"
CUTS = ("\n(history=", "\nGiven this context", "\nhistory:", "\nForecast")
FREQUENCIES = {"hourly": "1h", "daily": "1d", "weekly": "1w", "monthly": "1M", "quarterly": "1q", "yearly": "1y"}


def forecast_record(items: DataFrame) -> DataFrame:
    """items (series_id, text, history, future, kt) as forecast records: text, spans, statistics.

    Values are normalised by the history alone; the target repeats the history before the future.
    """
    m = S.mean(F.col("history"))
    rows = items.where((F.size("history") >= 2) & (F.size("future") >= 1)).withColumn("mean", m).withColumn("std", S.std_floor(F.col("mean"), S.std(F.col("history"))))
    z = lambda c: F.transform(c, lambda x: F.round((x - F.col("mean")) / F.col("std"), 6))
    text = F.concat(F.lit(USER), F.col("text"), F.lit("\n(history="), F.lit(TS), F.lit(")" + END + "\n" + ASSISTANT), F.lit(TS), F.lit(END + "\n"))
    h = F.size("history")
    span = lambda role, values, start: F.struct(F.size(values).alias("len"), F.lit(role).alias("role"), values.alias("values"), start.alias("loss_start"))
    spans = F.array(span("context", z(F.col("history")), h), span("target", z(F.concat("history", "future")), h))
    return rows.select("series_id", "dataset", "origin", "kt", text.alias("text"), F.lit("ts_forecast").alias("task_type"), spans.alias("timeseries"), F.array().cast("array<array<int>>").alias("ranges"), "mean", "std")


def description_record(items: DataFrame) -> DataFrame:
    """items as description records: the answer's characters are the loss range."""
    head = F.concat(F.lit(USER), F.lit("Describe the series. "), F.lit(TS + END + "\n" + ASSISTANT))
    start, n = F.length(head), F.length("text")
    m = S.mean(F.col("history"))
    rows = items.where(F.size("history") >= 1).withColumn("mean", m).withColumn("std", S.std_floor(F.col("mean"), S.std(F.col("history"))))
    values = F.transform("history", lambda x: F.round((x - F.col("mean")) / F.col("std"), 6))
    span = F.struct(F.size("history").alias("len"), F.lit("observed").alias("role"), values.alias("values"), F.lit(0).alias("loss_start"))
    return rows.select("series_id", "dataset", "origin", "kt", F.concat(head, "text", F.lit(END + "\n")).alias("text"), F.lit("text_desc").alias("task_type"), F.array(span).alias("timeseries"), F.array(F.array(start, start + n)).alias("ranges"), "mean", "std")


def description(text: Column, ranges: Column) -> Column:
    """What the loss ranges cover, else the assistant's turn."""
    parts = F.array_join(F.transform(ranges, lambda r: F.substring(text, r[0] + 1, r[1] - r[0])), " ")
    return F.when(F.size(ranges) > 0, parts).otherwise(turn(text, ASSISTANT))


def turn(text: Column, mark: str) -> Column:
    """The first turn of a speaker, or an empty string."""
    return F.regexp_extract(text, "(?s)\\Q" + mark + "\\E(.*?)\\Q" + END + "\\E", 1)


def before_any(text: Column, marks: tuple[str, ...] = CUTS) -> Column:
    for m in marks:
        text = F.split(text, "\\Q" + m + "\\E", 2)[0]
    return text


def denormalised(values: Column, m: Column, s: Column) -> Column:
    return F.transform(values, lambda z: z * s + m)


def pretraining_text(text: Column, channels: Column) -> Column:
    """text without its last full stop and blanks, then a stop and a token for each channel."""
    return F.concat(F.rtrim(text, F.lit(". ")), F.lit(". "), F.repeat(F.lit(TS), channels))


def clean_answer(text: Column) -> Column:
    """text without series tokens, and without the seams that they leave in punctuation."""
    out = F.regexp_replace(text, "\\s*<ts></ts>\\s*", " ")
    out = F.regexp_replace(out, "\\s+([.,;:])", "$1")
    out = F.regexp_replace(out, "([.,;:])\\1+", "$1")
    return F.trim(F.regexp_replace(out, "\\s{2,}", " "))


def place(text: Column) -> Column:
    """A place name without a leading year and a trailing Earthquake."""
    out = F.regexp_replace(F.regexp_replace(text, "^\\d{4}\\s+", ""), "(?i)\\s*earthquake$", "")
    return F.coalesce(F.nullif(out, F.lit("")), text)


def plain(html: Column) -> Column:
    """Tags out, white space to one space, the common character references decoded."""
    out = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "\\s+", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return F.trim(out)


def compressed(sentences: Column, words: int) -> Column:
    """Leading sentences while they fit into a budget of words."""
    size = lambda s: F.size(F.split(F.trim(s), "\\s+"))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.filter(sentences, lambda s: F.lit(False)).alias("kept"))
    step = lambda a, s: F.when(a["full"] | (a["n"] + size(s) > words), F.struct(a["n"].alias("n"), F.lit(True).alias("full"), a["kept"].alias("kept"))).otherwise(F.struct((a["n"] + size(s)).alias("n"), F.lit(False).alias("full"), F.array_append(a["kept"], s).alias("kept")))
    return F.aggregate(sentences, start, step, lambda a: F.array_join(a["kept"], " "))
