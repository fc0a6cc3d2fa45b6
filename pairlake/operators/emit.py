"""Records in and out: provenance, dispatch by format, versioned JSON, converters, builders of text, reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..functions import series as S
from . import pairs as P
from . import retrieve as R
from . import validate as C

# Versions, markers and words of the formats.
BUILDER, PAIR_VERSION = "pairlake@1", "pair@1"
FORMATS, KINDS = ("chatml", "cpt", "ir"), ("ts_to_text", "text_to_ts")
CAUSE_CUTS = ("\n(history=", "Given this background", " Given this", " Given the")
EVENTS_MARKER = "Recent related events"


def stamped(rows: DataFrame, source: Column, generated: Column, known: Column) -> DataFrame:
    """rows with where they come from; a text that isn't real as given is derived."""
    quality = F.when(generated == "real", "real").otherwise("derived")
    return rows.withColumns({"builder": F.lit(BUILDER), "pair_schema_version": F.lit(PAIR_VERSION), "text_source": source, "is_generated_text": generated, "text_quality": quality, "knowledge_time": known})


def dispatched(kind: Column, fmt: Column) -> Column:
    """emitted, unsupported (pretraining records only describe) or unknown."""
    return F.when(~fmt.isin(*FORMATS) | ~kind.isin(*KINDS), "unknown").when((fmt == "cpt") & (kind == "text_to_ts"), "unsupported").otherwise("emitted")


def to_record(rows: DataFrame) -> DataFrame:
    """rows (kind, text, history, future) with errors and record, the JSON of a valid one, else null."""
    rows = rows.withColumn("errors", C.example_errors(F.col("kind"), F.col("text"), F.col("history"), F.col("future")))
    record = F.to_json(F.struct(F.lit(PAIR_VERSION).alias("schema_version"), "kind", F.struct("text", "history", "future").alias("payload")))
    return rows.withColumn("record", F.when(F.size("errors") == 0, record))


def from_record(rows: DataFrame) -> DataFrame:
    """rows (record) with payload (text, history, future) and error: the first of version, kind, payload, or what isn't valid in it."""
    shape = "struct<schema_version:string,kind:string,payload:struct<text:string,history:array<double>,future:array<double>>>"
    rows = rows.withColumn("r", F.from_json("record", shape))
    p = F.col("r.payload")
    wrong = C.example_errors(F.col("r.kind"), p["text"], p["history"], p["future"])
    error = F.when(~F.coalesce(F.col("r.schema_version") == PAIR_VERSION, F.lit(False)), "schema_version").when(~F.coalesce(F.col("r.kind").isin(*KINDS), F.lit(False)), "kind")
    error = error.when(p.isNull(), "payload").otherwise(F.get(wrong, F.lit(0)))
    return rows.withColumn("error", error).withColumn("payload", p).drop("r")


def cleaned(text: Column) -> Column:
    """text without series tokens and without the seams they leave."""
    out = F.trim(F.replace(text, F.lit(P.TS), F.lit(" ")))
    for pattern, by in ((r"\s+([.,;:])", "$1"), (r"[:\-–—]\s*\.", "."), (r"\s{2,}", " "), (r"\bat\s*\.", ".")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def described(rows: DataFrame) -> DataFrame:
    """Pretraining rows (text, history) with answer, values and note, those with an answer of ten characters."""
    middle = F.contains("text", F.lit(P.TS)) & ~F.col("text").rlike(r"[:.]\s*<ts></ts>")
    out = rows.withColumn("answer", cleaned(F.col("text"))).withColumn("values", F.col("history")).withColumn("note", F.when(middle, "ts_mid_sentence").otherwise("ok"))
    return out.where((F.length("answer") >= 10) & (F.size("values") > 0))


def user_text(text: Column) -> Column:
    """The user's turn, else the whole text."""
    return F.when(F.contains(text, F.lit(P.USER)), P.turn(text, P.USER)).otherwise(text)


def qa_cause(text: Column) -> Column:
    return F.regexp_replace(P.turn(text, P.USER), r"(?s)\s+Given this context.*", "")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \n\t\r"))


def fact(scenario: Column) -> Column:
    """A scenario from its marker on, else whole."""
    at = F.instr(scenario, EVENTS_MARKER)
    return stripped(F.when(at > 0, F.substring(scenario, at, F.length(scenario))).otherwise(scenario))


def predictions(covariates: Column, holidays: Column) -> Column:
    said = lambda c: F.when(~F.lower(F.coalesce(F.trim(c), F.lit(""))).isin("", "unknown"), F.trim(c))
    return F.concat_ws("  ", said(covariates), said(holidays))


def samples(rows: DataFrame, history: int, future: int, key: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """rows (past, future, fact, preds, events) cut to the last and first points, with text; ``cap`` of a key, spread evenly."""
    fit = rows.where((F.col("events") >= 1) & (F.size("past") >= history) & (F.size("future") >= future) & (F.col("fact") != ""))
    text = F.trim(F.concat(F.substring("fact", 1, 1200), F.lit(" "), F.substring("preds", 1, 1200)))
    fit = fit.withColumns({"history": F.slice("past", -history, history), "future": F.slice("future", 1, future), "text": F.substring(text, 1, 1600)})
    return R.even_spread(fit, key, order, cap)


def stats_map(rows: DataFrame, order: str) -> DataFrame:
    """series_id, mean, std of the last row of each series."""
    return rows.groupBy("series_id").agg(F.max_by(F.struct("mean", "std"), order).alias("s")).select("series_id", "s.*")


def span_norm(index: int, speaker: str, role: str, m: Column, s: Column, raw: Column, loss_start: Column, source: str, visible: bool) -> Column:
    floor = S.std_floor(m, s)
    return F.struct(
        F.lit(index).alias("span_idx"), F.lit(speaker).alias("speaker"), F.lit(role).alias("role"), m.alias("mean"), floor.alias("std"), raw.alias("raw_len"), loss_start.alias("loss_start"),
        (floor > s).alias("std_floor_applied"), F.lit(source).alias("renorm_source"), F.lit(None).cast("int").alias("reference_span_idx"), F.lit(visible).alias("stats_visible"), F.lit(False).alias("stats_supervised"),
    )


def raw_pool(values: Column) -> Column:
    more = F.array(F.array_min(values), F.array_max(values), S.mean(values), F.element_at(values, 1), F.element_at(values, -1))
    return F.when(F.size(values) > 0, F.concat(values, more)).otherwise(values)


def rectangular(rows: DataFrame, history: int, future: int) -> DataFrame:
    """rows long enough, cut to the last points of the history and the first of the future."""
    fit = rows.where((F.size("history") >= history) & (F.size("future") >= future))
    return fit.withColumn("history", F.slice("history", -history, history)).withColumn("future", F.slice("future", 1, future))


def lead_relevance(lead: Column, event: Column, title: Column) -> Column:
    """Share of the event's content words, the title's left out, that the lead has; null without any."""
    named = L.content_words(title)
    known = F.array_except(L.content_words(event), named)
    return F.when(F.size(known) > 0, F.round(F.size(F.array_intersect(F.array_except(L.content_words(lead), named), known)) / F.size(known), 3))


def completed(rows: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """rows with answer from a cache (key, answer), the smallest of several, null where it has none; nothing is ever called."""
    cache = cache.groupBy(F.col("key").alias("cache_key")).agg(F.min("answer").alias("answer"))
    return rows.join(cache, rows[key] == cache["cache_key"], "left").drop("cache_key")


def figures(values: Column) -> Column:
    """First, last, least, most and net change, to two places."""
    two = lambda c: F.round(c, 2)
    first, last = F.element_at(values, 1), F.element_at(values, -1)
    return F.struct(two(first).alias("a"), two(last).alias("z"), two(F.array_min(values)).alias("lo"), two(F.array_max(values)).alias("hi"), two(last - first).alias("change"))


def grounded(rows: DataFrame, values: Column, rel: float, fallback: str) -> DataFrame:
    """rows (candidate, template) with text and tag: the candidate if all its decimals are among the series' facts, else the template."""
    d = L.decimals(F.col("candidate"))
    good = F.col("candidate").isNotNull() & (F.size(d) > 0) & (F.size(L.unmatched(d, L.series_facts(values), rel)) == 0)
    good = F.coalesce(good, F.lit(False))
    return rows.withColumn("text", F.when(good, F.col("candidate")).otherwise(F.col("template"))).withColumn("tag", F.when(good, "derived_generated").otherwise(fallback))


def cve_text(cve: Column, product: Column, name: Column, description: Column) -> Column:
    head = F.concat_ws(" — ", F.nullif(product, F.lit("")), F.nullif(name, F.lit("")))
    return F.trim(F.concat(cve, F.lit(": "), head, F.lit(". "), F.coalesce(description, F.lit(""))))


def mainshock_text(title: Column, magnitude: Column, place: Column, day: Column, depth: Column, tsunami: Column) -> Column:
    more = F.when(tsunami, " A tsunami was observed or warned.").otherwise("")
    return F.concat(title, F.lit(". The magnitude "), magnitude, F.lit(" earthquake struck near "), P.place(place), F.lit(" on "), day, F.lit(" at "), depth, F.lit(" km depth."), more)


def decoded(text: Column) -> Column:
    """text with the common character references decoded, an ampersand last."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def statement(pages: DataFrame, html: str) -> DataFrame:
    """pages with paragraphs over 40 characters, the statement (from what follows "For ... release ... Share" to the roster) and its decision."""
    bare = F.transform(F.regexp_extract_all(html, F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: decoded(F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]+>", ""), r"\s+", " "))))
    pages = pages.withColumn("paragraphs", F.filter(bare, lambda p: F.length(p) > 40))
    head = r"For .*?release.*?\bShare\b\s*(.*)"
    place = lambda c, test: F.coalesce(F.get(F.filter(F.transform(c, lambda p, i: F.when(test(p), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(c))
    start = place(F.col("paragraphs"), lambda p: p.rlike(head))
    pages = pages.withColumn("start", start)
    rest = F.slice("paragraphs", F.col("start") + 2, F.greatest(F.size("paragraphs") - F.col("start") - 1, F.lit(0)))
    pages = pages.withColumn("rest", rest)
    stop = place(F.col("rest"), lambda p: F.startswith(F.lower(p), F.lit("voting for")) | F.startswith(p, F.lit("Board of Governors")))
    first = F.array(F.regexp_extract(F.coalesce(F.get("paragraphs", F.col("start")), F.lit("")), head, 1))
    body = F.filter(F.concat(first, F.slice("rest", F.lit(1), stop)), lambda p: p != "")
    pages = pages.withColumn("statement", F.array_join(body, " "))
    said = F.filter(F.split("statement", r"(?<=[.])\s+"), lambda s: F.contains(F.lower(s), F.lit("target range for the federal funds rate")))
    return pages.withColumn("decision", F.coalesce(F.get(said, F.lit(0)), F.lit(""))).drop("start", "rest")


def wiki_reason(complete: Column, points: Column, detected: Column, revision: Column, spike: Column, before: Column, after: Column, least_before: int, least_after: int) -> Column:
    """Why a single peak is or isn't emitted, the first that holds; detected: the detector's own reason or null."""
    return (
        F.when(~complete, "meta_incomplete").when(points < 60, "no_pageviews").when(detected.isNotNull(), detected).when(revision.isNull(), "no_prior_revision")
        .when(revision >= spike, "revision_not_before_spike").when((before < least_before) | (after < least_after), "insufficient_history_or_horizon").otherwise("emitted")
    )


def oil_reason(articles: Column, at: Column, points: Column, verified: Column, history: int, future: int) -> Column:
    return F.when(articles == 0, "no_retrieval").when((at < history) | (at + future > points), "series_boundary").when(~verified, "no_verified_cause").otherwise("emitted")


def long_window(rows: DataFrame, at: Column, seed: Column, before: int = 730, after: int = 120) -> DataFrame:
    return rows.where((at >= seed - F.expr(f"INTERVAL {before} DAY")) & (at <= seed + F.expr(f"INTERVAL {after} DAY")))
