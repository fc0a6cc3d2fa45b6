"""Deterministic text gates as columns: leaks, entities, numbers, coupling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide what the gates catch.
PRICE_PROJECTION = (
    r"(?i)\b(price|valuation)\s+(target|forecast|estimate|projection|outlook)s?\b"
    r"|\b(forecast|estimate|projection|outlook)s?\s+(for|of)\s+[\w\s,'-]{0,25}\bprices?\b"
    r"|\bprojecting\b[\w\s,'-]{0,45}\b(rise|rising|rally|surge|surging|reach\w*|higher|increase|appreciat\w*|upside|bullish|climb\w*)\b"
    r"|\b(forecast|estimat|project|predict|expect|anticipat)\w*\b[\w\s,'-]{0,35}\b(will|to|would|could)\s+(rise|rising|rally|surge|reach|climb|hit|increase|jump|soar|higher|double|appreciate)\b"
)
DIRECTION = (
    r"(?i)\b(will|won'?t|going to|gonna|expected to|set to|likely to|about to|poised to|forecast to|projected to|on track to|due to)\s+(?:go\s+|move\s+|head\s+|trend\s+|continue\s+)?"
    r"(up|down|higher|lower|rise|rising|risen|fall|falling|fallen|drop|dropping|climb|climbing|increase|increasing|decrease|decreasing|surge|surging|plunge|plunging|jump|soar|rally|decline|gain|gaining|weaken|strengthen|spike|spiking)\b"
    r"|\b(next|coming|following|subsequent|upcoming)\s+(day|days|week|weeks|month|months|period|quarter)s?[\w\s,'-]{0,40}\b(rise|rising|fall|falling|higher|lower|increase|decrease|up|down|surge|plunge)\b"
)
EVENTIVE = (
    r"(?i)\b(announced?|declared?|died|passed away|launched?|released?|unveiled?|reported|resigned?|elected?|arrested?|charged|signed|acquired?|merged?|filed|sued|banned?|approved?|rejected?|"
    r"halted?|suspended?|shut|reopened?|struck|hit|erupted?|crashed?|won|lost|defeated|beat|recalled?|voted?|passed|introduced?|imposed?|cut|raised?|hiked?|slashed?|warned?|confirmed?|"
    r"discovered?|attacked?|invaded?|withdrew|resumed?|delayed?|postponed?|canceled|cancelled|agreed?|nominated?|appointed?|fired|laid off|struck down|blocked?)\b"
)
STATIVE = r"(?i)\b(is|are|was|were|been|born|known for|based in|located in|refers to|consists of|comprises|has been|had been)\b"
RECENCY = r"(?i)\b(recent(ly)?|this week|this month|latest|current(ly)?|amid|following|in response to|days before|ahead of|as .* (concerns|tensions|fears|hopes))\b"
BORN = r"(?i)^\s*[A-Z][^.\n]{0,90}?\(\s*;?\s*born\b"
KIND = (
    r"(?i)\bis (?:a|an|the) (?:[a-z]+ ){0,3}(wrestler|singer|actor|actress|rapper|politician|footballer|player|athlete|writer|author|musician|band|group|company|corporation|city|town|country|state|film|movie|song|album|series|"
    r"novel|video game|character|team|league|university|river|mountain|island|festival|holiday|television|drama|franchise|organization|organisation|breed|species)\b"
)
ACRONYM, MULTIWORD, TITLE = r"\b[A-Z][A-Z&+]{1,6}\b", r"\b[A-Z][a-z]+(?:[ -][A-Z][a-z]+)+\b", r"\b[A-Z][a-z]{2,}\b"
KNOWN = (
    "russia ukraine china iran iraq israel palestine gaza saudi venezuela libya nigeria germany france britain japan india brazil turkey syria yemen qatar kuwait norway canada mexico "
    "opec iea eia fed eu un nato wti brent covid omicron delta coronavirus pandemic biden putin trump powell zelensky xi"
).split()
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


#: Words, digits and their bounds are those of all scripts, not of ASCII alone.
ALL_SCRIPTS = "(?U)"


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ALL_SCRIPTS + pattern), F.lit(group))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(ALL_SCRIPTS + pattern)


def future_year(text: Column, origin: Column) -> Column:
    """Whether a year after the origin's is named; false for an origin without a year."""
    year = F.regexp_extract(origin, r"^(\d{4})", 1).try_cast("int")
    return F.coalesce(F.exists(all_of(text, r"\b(20\d{2})\b", 1), lambda y: y.cast("int") > year), F.lit(False))


def score(text: Column, event_date: Column) -> dict[str, Column]:
    """match score in 0..1 to three places, and its label."""
    ev, st = F.regexp_count(text, F.lit(ALL_SCRIPTS + EVENTIVE)), F.regexp_count(text, F.lit(ALL_SCRIPTS + STATIVE))
    recency = has(text, RECENCY)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.nullif(F.regexp_extract(event_date, r"^\d{4}-(0[1-9]|1[0-2])", 1), F.lit("")).cast("int"))
    named = F.coalesce(F.contains(F.lower(text), F.lower(month)), F.lit(False))
    bio = has(text, BORN) | has(text, KIND)
    one = lambda c: c.cast("int")
    raw = 50 * one(ev >= 1) + 20 * one(ev >= 2) + 20 * one(recency) + 15 * one(named) - 55 * one(bio) - 6 * F.greatest(F.lit(0), st - 1)
    weak = (bio | ((st >= 2) & (ev == 0))) & ~((ev >= 1) | recency | named)
    return {"n_eventive": ev, "n_stative": st, "score": F.greatest(F.lit(0), F.least(F.lit(100), raw)) / 100.0, "label": F.when(weak, "weak").otherwise("coupled")}


def unique_fold(values: Column) -> Column:
    """The values in order, those that repeat one in another case left out."""
    empty = F.filter(values, lambda x: F.lit(False))
    return F.aggregate(values, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)) | (x == ""), acc).otherwise(F.array_append(acc, x)))


def entities(text: Column) -> Column:
    known = F.filter(all_of(text, TITLE), lambda w: F.lower(w).isin(KNOWN))
    found = F.concat(all_of(text, ACRONYM), all_of(text, MULTIWORD), known)
    return unique_fold(F.transform(found, lambda e: F.trim(F.regexp_replace(e, r"^(?:The|A|An)\s+", ""))))


def forms(entity: Column) -> Column:
    """The lower-case forms that trace an entity."""
    long = F.filter(F.split(F.lower(entity), "[ /-]+"), lambda t: F.length(t) >= 4)
    acronym = F.when((F.upper(entity) == entity) & entity.rlike("[A-Z]") & (F.length(entity) >= 2), F.array(F.lower(entity))).otherwise(F.filter(long, lambda x: F.lit(False)))
    words = F.filter(F.split(entity, "[ -]+"), lambda w: w.rlike("^[A-Z]"))
    initials = F.when(F.size(words) >= 2, F.array(F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))).otherwise(F.filter(long, lambda x: F.lit(False)))
    out = F.concat(long, acronym, initials)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lower(entity)))


def traced(entity: Column, grounding: Column) -> Column:
    """Whether the first six characters of a form start a word of the grounding."""
    g = F.concat(F.lit(" "), F.regexp_replace(F.lower(grounding), "[^a-z0-9]+", " "))
    return F.exists(forms(entity), lambda f: F.contains(g, F.concat(F.lit(" "), F.substring(f, 1, 6))))


def weak_entity(entity: Column) -> Column:
    return entity.rlike("^[A-Z]{2}$")


def decimals(text: Column) -> Column:
    return F.transform(all_of(text, r"\d+\.\d+"), lambda x: x.cast("double"))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(all_of(text, r"-?\d[\d,]*\.?\d*"), lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull()))


def series_facts(values: Column) -> Column:
    """The numbers a text may state: values, first, last, extremes, net change; two places."""
    first, last = F.element_at(values, 1), F.element_at(values, -1)
    more = F.array(first, last, F.array_min(values), F.array_max(values), last - first, F.abs(last - first))
    return F.array_distinct(F.transform(F.concat(values, more), lambda v: F.round(v, 2)))


def unmatched(found: Column, allowed: Column, rel: float = 0.0, least: float = 0.02) -> Column:
    return F.filter(found, lambda n: ~F.exists(allowed, lambda a: F.abs(n - a) <= F.greatest(F.lit(least), rel * F.abs(a))))


def policy_numbers(text: Column) -> Column:
    """Mixed and plain fractions, and bare bounds before percent or to."""
    folded = F.translate(text, "‐‑‒–—", "-----")
    over = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    mixed = F.transform(all_of(folded, r"\d+-\d+/\d+"), lambda m: F.split(m, "-")[0].cast("double") + over(F.split(F.split(m, "-")[1], "/")[0], F.split(m, "/")[1]))
    rest = F.regexp_replace(folded, r"\d+-\d+/\d+", " ")
    plain = F.transform(all_of(rest, r"\d+/\d+"), lambda m: over(F.split(m, "/")[0], F.split(m, "/")[1]))
    rest = F.regexp_replace(rest, r"\d+/\d+", " ")
    bounds = F.transform(all_of(rest, r"(\d+)\s+(?:percent|to)\b", 1), lambda m: m.cast("double"))
    return F.array_distinct(F.array_compact(F.transform(F.concat(mixed, plain, bounds), lambda v: F.round(v, 2))))


def anonymous(text: Column, found: Column, name: str = "a major entity") -> Column:
    """Entities replaced, longer ones first."""
    ordered = F.reverse(F.array_sort(F.transform(found, lambda e: F.struct(F.length(e).alias("n"), e.alias("e")))))
    return F.aggregate(ordered, text, lambda acc, x: F.replace(acc, x["e"], F.lit(name)))


def outcome(nouns: Sequence[str]) -> str:
    """Pattern of a price noun near a direction verb, in either order, within a sentence."""
    n, v = "|".join(nouns), "rose|fell|surged|jumped|dropped|climbed|plunged|rallied|tumbled|soared|slid|gained"
    return rf"(?i)\b({n})\b[^.]{{0,60}}\b({v})\b|\b({v})\b[^.]{{0,60}}\b({n})\b|\b(rising|falling|surging|soaring|plunging) ({n})\b"


# Words and patterns of the stricter gate, of revenue drivers, and words without content.
RICH_DIRECTION = (
    r"fell|falls?|dropp?e?d?s?|plunged?s?|tumbled?s?|slid|slides?|sank|slumped?s?|crashed|rose|rises?|risen|surged?s?|jumped?s?|rallied|climbed|soared|gained|declined?s?|dived|"
    r"weakened?s?|strengthened?s?|rebounded?s?"
)
ASSET = (
    r"(?i)\b(oil|crude|brent|petroleum|gas|lng|bitcoin|btc|ether\w*|crypto\w*|coin|token|blockchain|pound|sterling|euro|dollar|yen|currency|forex|"
    r"price|prices|market|markets|rate|rates|index|indices)\b"
)
PRICE_FIGURE = r"(?i)\$\s?\d|\b\d{1,3},\d{3}\b|\b(?:above|below|past|reached|reaching|hit|hitting|breaking|topping|level|levels|threshold|mark)\b[^.]{0,18}\$?\d"
DRIVER = (
    r"(?i)(?:net sales|total net sales|total revenues?|revenues?|total revenue)\b[^.]{0,40}?(?:increased|decreased|grew|rose|declined)\b[^.]*?"
    r"(?:due to|driven by|primarily|reflect|as a result|attributable to)[^.]*\."
)
HEADINGS = ("Management’s Discussion and Analysis", "Management's Discussion and Analysis", "Results of Operations")
PLAIN_WORDS = ("the", "and", "for", "was", "with")


def content_words(text: Column) -> Column:
    return F.array_except(all_of(F.lower(text), "[a-z][a-z'-]{2,}"), F.array(*map(F.lit, PLAIN_WORDS)))


def rich_leak(text: Column) -> Column:
    """A price figure anywhere, or an asset word from 40 characters before a direction verb to 15 after it."""
    verbs, gaps = all_of(text, "(?i)" + RICH_DIRECTION), F.split(text, ALL_SCRIPTS + "(?i)" + RICH_DIRECTION)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        low = F.greatest(at - 40, F.lit(0))
        near = F.substring(text, low + 1, at + F.length(x["verb"]) + 15 - low)
        return F.struct((at + F.length(x["verb"])).alias("at"), (acc["hit"] | has(near, ASSET)).alias("hit"))

    pairs = F.zip_with(verbs, F.slice(gaps, 1, F.size(verbs)), lambda v, g: F.struct(v.alias("verb"), g.alias("gap")))
    return has(text, PRICE_FIGURE) | F.aggregate(pairs, start, step, lambda a: a["hit"])


def year_value_errors(text: Column, labelled: dict[int, float], rel: float = 0.01, least: float = 0.5) -> Column:
    """Pairs of a value and a year near after it where the value is another labelled year's and not that one's."""
    pattern = r"(\d+(?:\.\d+)?)[^.\d\n]{0,12}?((?:19|20)\d{2})"
    pairs = F.zip_with(all_of(text, pattern, 1), all_of(text, pattern, 2), lambda v, y: F.struct(v.cast("double").alias("value"), y.alias("year")))
    right = F.create_map(*(F.lit(x) for y, v in labelled.items() for x in (str(y), float(v))))
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(least), rel * F.abs(b))
    values = F.array(*(F.lit(float(v)) for v in labelled.values()))
    own = lambda p: F.element_at(right, p["year"])
    return F.filter(pairs, lambda p: F.coalesce(~near(p["value"], own(p)), F.lit(False)) & F.exists(values, lambda v: near(p["value"], v)))


#: (pattern, what stands instead) in order; templates and files nest up to twelve deep.
DEPTH = 12
WIKITEXT = [
    *[("(?s)<!--.*?-->", ""), ("<ref[^>]*/>", ""), ("(?is)<ref[^>]*>.*?</ref>", "")],
    *[(r"\{\{[^{}]*\}\}", "")] * DEPTH,
    *[(r"(?i)\[\[(?:File|Image):[^\[\]]*\]\]", "")] * DEPTH,
    *[(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"), (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"), (r"\[https?://[^\s\]]+\]", "")],
    *[(r"(?s)\{\|.*?\|\}", ""), ("'''", ""), ("''", ""), ("<[^>]+>", ""), (r"[ \t]+", " ")],
]


def wikitext(text: Column) -> Column:
    """Comments, references, templates and files (nested), links, tables, quotes and tags out."""
    for pattern, by in WIKITEXT:
        text = F.regexp_replace(text, pattern, by)
    return F.btrim(text, F.lit(" \n\t\r"))


def drivers(text: Column, n: int = 4, region: int = 16000) -> Column:
    """The first n sentences on what drove revenue, from the last heading on (a region of characters) or in the whole text."""
    after = F.lit(None).cast("string")
    for heading in HEADINGS:
        parts = F.split(text, "\\Q" + heading + "\\E")
        after = F.coalesce(after, F.when(F.size(parts) > 1, F.concat(F.lit(heading), F.element_at(parts, -1))))
    found = F.transform(all_of(F.coalesce(F.substring(after, 1, region), text), DRIVER), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.array_join(F.slice(F.filter(unique_fold(found), lambda s: (F.length(s) > 30) & (F.length(s) < 320)), 1, n), " ")
