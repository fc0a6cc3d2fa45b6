"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by its link density, its
length and its stop-word density, whatever element it stands in: much of it linked is boilerplate, long
and rich in stop words is main text, a short one that begins as a copyright line is not. Only containers that are never
main text (menus, page headers and footers, sidebars, adverts, consent forms, reader comments) decide without
it; names that main text may bear too (search, notice, related, share and the like) decide only what measures leave open, and no
heading. Other short, middling and stop-word-poor blocks stay open, and in the second pass inherit the label of their
nearest decided neighbours: those in article or main elements for blocks there, a heading that of what
follows. Blocks that their container decides are nobody's neighbours. What is hidden is hidden by the attributes hidden
and aria-hidden or by display:none in its style.

Character references are decoded, white space in a block becomes one space, blocks are joined by one
space in page order; nothing else is dropped or capped. Null or empty html gives an empty string.
Broken markup is read as far as it goes: unclosed tags end with their parent, an unclosed script or
comment runs to the end. Repeated rows are read each; null ids and urls stay null. An empty table gives
no rows, other columns are not read, and a very long page costs memory in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds of the first pass: characters of a short and of a long block, densities of links and stop words.
SHORT, LONG, LINKED, FEW_STOPS, MANY_STOPS = 70, 200, 0.5, 0.08, 0.18

#: Tags and words of the HTML and of four languages.
RAW = set("script style noscript template textarea title svg iframe object select option head".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("aside button dialog footer form label menu nav".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification notifications popup modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars widget widgets related recommended share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs masthead "
    "header footer copyright comment comments disqus respond reply replies toolbar pagination pager login hidden contentinfo complementary dialog search alert".split()
)
#: Marks that only decide what measures leave open.
WEAK = set("header search notice notices notification notifications alert related recommended share sharing social widget widgets toolbar promo promotion overlay".split())
PLAIN = set("area bar block bottom box container group inner item items left links list main outer page right section site slot top unit wrap wrapper".split())
STOPS = set(
    "the of and to in a is that it for on was be with as by this are at from or an have not but they his her you we he she which will would there their what all "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais comme nous sa été leur cette "
    "el los del las por con una su para al lo más este ya pero sus ha me si sin sobre entre cuando muy también fue hasta desde".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile("class|id|role|hidden|style", re.I)
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
PIECES = re.compile(r"[-_]+")
EDGES = re.compile(r"^\W+|\W+$")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


class Block:
    __slots__ = ("text", "linked", "bad", "weak", "article", "heading", "label", "stops")

    def __init__(self, text: str, linked: int, mark: int, article: bool, heading: bool):
        self.text, self.bad, self.weak, self.article, self.heading = text, mark == 2, mark == 1, article, heading
        self.linked = linked / max(1, len(text))
        words = [EDGES.sub("", w).lower() for w in text.split()]
        self.stops = sum(w in STOPS for w in words) / max(1, len(words))
        self.label: bool | None = None


def strength(token: str) -> int:
    """Whether a class, id or role names boilerplate, as a whole or by marks and plain words alone: 2, 1 if by weak marks alone, else 0."""
    pieces = [x.rstrip("0123456789") for x in PIECES.split(token.lower())]
    marks = [x for x in pieces if x in MARKS]
    if not marks or not all(x in MARKS or x in PLAIN for x in pieces if x):
        return 0
    return 1 if all(x in WEAK for x in marks) else 2


def is_mark(token: str) -> bool:
    return strength(token) > 0


def marked(rest: str, article: bool) -> int:
    """What the attributes of a tag say, as strength; a header in an article is its own."""
    most = 0
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and UNSEEN.search(value)):
            return 2
        if name in ("class", "id", "role"):
            for token in value.split():
                most = max(most, 0 if article and "header" in PIECES.split(token.lower()) else strength(token))
    return most


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have words, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # name, mark, article; each with what is above
    parts: list[str] = []
    linked = link = 0
    heading = ""
    at, size = 0, len(page)

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            mark, article = stack[-1][1:] if stack else (0, False)
            out.append(Block(text, min(linked, len(text)), mark, article, bool(heading)))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        m = TOKEN.match(page, mark)
        if not m or (m.group(2) is None and not page.startswith(("<!", "<?"), mark)):
            say(page[at : mark + 1])
            at = mark + 1
            continue
        say(page[at:mark])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name == "a":
                link = 0
            elif name in BLOCKS or any(x[0] == name for x in stack):
                if name in BLOCKS:
                    end()
                close(name)
                heading = ""
            continue
        rest = m.group(3) or ""
        if name in RAW and name != "head" and not rest.endswith("/"):
            shut = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            link = 1
        if name in BLOCKS:
            end()
            link = 0
            if stack and stack[-1][0] == "p":
                stack.pop()
            if name == "li":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "menu"):
                        break
                    if stack[i][0] == "li":
                        del stack[i:]
                        break
            heading = name if re.fullmatch("h[1-6]", name) else ""
        if name in VOID or rest.endswith("/"):
            continue
        inside = bool(stack and stack[-1][2])
        own = 2 if name in BOILERPLATE or (name == "header" and not inside) else 0
        if rest and not own and name not in ("body", "html", "main", "article") and TELLING.search(rest):
            own = marked(rest, inside)
        if own or name in BLOCKS:
            if own and name not in BLOCKS:
                end()
            above = stack[-1] if stack else ("", 0, False)
            stack.append((name, max(above[1], own), above[2] or name in ("article", "main")))
        elif name not in BLOCKS and name != "a" and stack and any(x[0] == name and x[1] for x in stack):
            stack.append((name, *stack[-1][1:]))  # so that its end tag doesn't end the marked one above
    end()
    return out


def decided(b: Block) -> bool | None:
    """The first pass: what a block's own measures say, if they do."""
    if b.bad or b.linked > LINKED or (len(b.text) < LONG and RIGHTS.match(b.text)):
        return False
    if b.heading:
        return None
    if len(b.text) >= SHORT and (b.stops >= MANY_STOPS or (b.stops >= FEW_STOPS and len(b.text) > LONG)):
        return True
    return False if b.weak else None


def inherited(row: list[Block], first: list[bool | None]) -> None:
    """The second pass over blocks in page order: open ones take the label of the nearest decided one, of both if they agree."""
    before, after = [None] * len(row), [None] * len(row)
    for side, order in ((before, range(len(row))), (after, range(len(row) - 1, -1, -1))):
        near = None
        for i in order:
            if first[i] is not None:
                near = i
            side[i] = near
    for i, b in enumerate(row):
        x, y = before[i], after[i]
        if first[i] is not None:
            b.label = first[i]
        elif x is None and y is None:
            b.label = True  # nothing speaks against it
        elif x is None or y is None:
            b.label = first[y if x is None else x]
        elif first[x] == first[y] or i - x == y - i:
            b.label = first[y] if b.heading or first[x] == first[y] else b.stops >= FEW_STOPS
        else:
            b.label = first[y] if b.heading else first[x if i - x < y - i else y]


def classify(found: list[Block]) -> None:
    """Labels all blocks: main text or not."""
    first = [decided(b) for b in found]
    for b, label in zip(found, first):
        b.label = label
    inside = [i for i, b in enumerate(found) if b.article and not b.bad]
    inherited([found[i] for i in inside], [first[i] for i in inside])
    # open blocks elsewhere look at the whole page, where an article's labels stand; what its container decides is no neighbour
    rest = [b for b in found if not b.bad]
    inherited(rest, [b.label for b in rest])


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return " ".join(b.text for b in found if b.label)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch[2]]
            out = [batch[0], batch[1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
