"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of text becomes a line. Text lengths are
summed over a sliding window of ``WINDOW`` lines; a stretch of page begins where the
sums surge from nothing and ends where they dive to nothing, and the text
between is kept. Lines of elements that aren't prose by their own account
(menus, footers, adverts, forms, comments and the like) count nothing and leave a gap as wide as the
window, so that they part the stretches around them. Where a page marks its article (or
names its content), the stretches inside are kept, however short; elsewhere a stretch
must be dense, in itself or against the page's densest, and lines that are mostly links count nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: Window sum of text from which a stretch of an unmarked page counts as prose.
SURGE = 86

# Element names and words of class, id and role that tell what an element holds.
RAW = {"script", "style", "title", "noscript", "iframe", "template", "textarea", "xmp", "svg", "math", "canvas", "object", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "label", "audio", "video", "datalist", "option"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "img",
}
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
NEVER_BY_NAME = {"html", "body", "main"}
OTHER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs",
    "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "discussion",
    "disqus", "footer", "form", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "promoted", "recommended", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "toc", "toolbar", "topbar", "warning", "widget", "widgets",
}
NOT_WORDS = {"has", "no", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Elements whose end tag may be left out, the start tags that end them, and the elements they are not ended across.
_BLOCKS = {
    "address", "article", "aside", "blockquote", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
    "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot",
}
_TABLE = {"table"}
IMPLIED: list[tuple[str, set[str], set[str]]] = [
    ("p", _BLOCKS, {"table", "td", "th", "caption", "button", "object"}),
    ("option", {"option", "optgroup"}, {"select", "datalist"}),
    ("li", {"li"}, {"ul", "ol", "menu"}),
    ("dt", {"dt", "dd"}, {"dl"}),
    ("dd", {"dt", "dd"}, {"dl"}),
    ("td", {"td", "th", "tr", "thead", "tbody", "tfoot"}, _TABLE),
    ("th", {"td", "th", "tr", "thead", "tbody", "tfoot"}, _TABLE),
    ("tr", {"tr", "thead", "tbody", "tfoot"}, _TABLE),
]
_ENDS: dict[str, list[tuple[str, set[str]]]] = {}
for _open, _starts, _walls in IMPLIED:
    for _start in _starts:
        _ENDS.setdefault(_start, []).append((_open, _walls))

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$",
    re.S,
)
#: Attributes one by one, values whole, so that what a value says is never taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GAP = None


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """``skip``, ``layout`` (skipped by its name only), ``inner`` (an article's header), ``main``, ``maybe`` (by its name only) or nothing."""
    if tag in SKIP or (tag == "header" and not inside):
        return "skip"
    words: set[str] = set()
    layout = False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
            ):
                return "" if tag in NEVER_BY_NAME else "skip"
            if name == "role" and value == "main":
                return "main"
            if name in ("class", "id", "role"):
                for part in value.split():
                    here = [w.lower() for w in _WORD.findall(part)]
                    if here and not NOT_WORDS.intersection(here):
                        words.update(here)
                        # inside an article a name that ends in a layout word says layout, as in article-share
                        layout |= here[-1] in OTHER_WORDS
    if tag not in NEVER_BY_NAME:
        if "comment" in words or "comments" in words:
            return "skip"
        if words & OTHER_WORDS and tag != "article" and (layout or not (inside and words & MAIN_WORDS)):
            return "layout"
    if tag == "header":
        return "inner"
    if tag in MAIN_TAGS:
        return "main"
    return "maybe" if words & MAIN_WORDS and tag not in ("html", "body") else ""


def lines(page: str) -> list[tuple[str, int, int] | None]:
    """Text blocks in page order as (text, how it is marked, characters of links); None for a gap.

    Marks: 2 in an article, 1 under a name that says content, 0 elsewhere, -1 in an article below a wrapper of a layout name.
    """
    out: list[tuple[str, int, int] | None] = []
    text: list[str] = []
    stack: list[tuple[str, str, int]] = []  # open elements, their kinds, and what was skipped when they began
    places: dict[str, list[int]] = {}  # where in the stack each name is open
    skipping = main = maybe = linked = anchors = wrapped = hard = inner = headings = 0

    def close() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((joined, -1 if wrapped else 2 if main else 1 if maybe else 0, linked))
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        # of an article's own header only the headings are its text
        if not skipping and (not inner or headings):
            text.append(piece)
            if anchors:
                linked += len(piece.strip())

    def end_of(tag: str) -> None:
        """Close the elements down to the last open ``tag``."""
        nonlocal skipping, hard, wrapped, main, maybe, anchors, inner, headings
        while stack:
            t, kind, before = stack.pop()
            places[t].pop()
            if kind in ("skip", "layout"):
                skipping -= 1
                hard -= kind == "skip"
                if not skipping:
                    out.extend([_GAP] * WINDOW)
            elif kind == "wrapped":
                if not skipping:
                    close()
                skipping += before
                wrapped -= 1
                main -= 1
            main -= kind == "main"
            maybe -= kind == "maybe"
            inner -= kind == "inner"
            headings -= t in HEADINGS
            anchors -= t == "a"
            if t == tag:
                break

    at, raw = 0, ""
    for m in _TOKEN.finditer(page):
        tag = (m[2] or m[5] or "").lower()
        end = bool(m[1] or m[4])
        if raw and not (end and tag == raw):
            continue
        if raw:
            at, raw = m.end(), ""
            continue
        say(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if tag not in INLINE:
            if not skipping:
                close()
        if end:
            if places.get(tag):
                end_of(tag)
            continue
        if tag in RAW:
            raw = "" if (m[3] or m[6] or "").endswith("/") else tag
            continue
        for ended, walls in _ENDS.get(tag, ()):
            if places.get(ended) and all(places[ended][-1] > places[w][-1] for w in walls if places.get(w)):
                end_of(ended)
        if tag not in VOID:
            kind = _kind(tag, m[3] or m[6] or "", bool(main))
            before = 0
            if kind in ("skip", "layout"):
                if not skipping:
                    close()
                    out.extend([_GAP] * WINDOW)
                skipping += 1
                hard += kind == "skip"
            elif kind == "main" and skipping and not hard:
                # a layout name around an article or main element doesn't hide it
                kind, before, skipping = "wrapped", skipping, 0
                wrapped += 1
                main += 1
            main += kind == "main"
            maybe += kind == "maybe"
            inner += kind == "inner"
            headings += tag in HEADINGS
            anchors += tag == "a"
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, kind, before))
    if not raw:
        say(page[at:])
    close()
    return out


def main_text(page: str | None) -> str:
    """The blocks between surges and dives, joined by one space.

    Articles below a wrapper of a layout name count where no other is marked, unless the rest of the page has more to say.
    """
    blocks = lines(page or "")
    marks = {b[1] for b in blocks if b}
    found = _stretches(blocks, max(marks - {-1}, default=0))
    if -1 in marks and 2 not in marks:
        found = max(_stretches(blocks, -1), found, key=len)
    return found


def _stretches(blocks: list[tuple[str, int, int] | None], level: int) -> str:
    # inside a marked article all stretches count; else those under a name that says content
    weights = [
        0 if b is None or b[1] != level or (level in (0, 1) and b[2] * 2 > len(b[0])) else len(b[0]) for b in blocks
    ]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    peak = max(sums, default=0)
    need = 1 if level or not peak else min(SURGE, peak / 2)
    kept, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= need:
            kept += [blocks[j][0] for j in range(i, dive) if weights[j]]
        i = dive
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    ``n_chars`` counts code points. A null or empty page, or one without prose, gives an empty text. Repeated
    rows are extracted each; other columns are ignored; an empty table gives an empty result.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "CAST(url AS STRING) AS url", "html")
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
