"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line's weight is the length of its
text outside links. Stripping also takes out what forms, menus, adverts, notices and the like hold: such
lines weigh nothing. Lines that the page marks as its article weigh up to twice their length, by no
more than a window's share of the threshold, so that a mark alone never lifts a window over it. The
distribution is the sum of weights over a sliding window of lines. Where it comes up over the threshold
there is a surge; the text around it reaches back and forth to where the distribution dives, that is to
windows without any weight, and its lines are kept. What lies between dives without a surge is dropped.

Defined results: null or empty html gives an empty text of 0 characters; a page without any surge gives
all its lines of weight; repeated rows each give a row; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import table

#: Elements whose content is no text, or no part of an article.
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "head", "canvas", "audio", "video", "xmp"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html",
    "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _ASIDE
#: Elements whose end tag may be left out: what closes them when it opens, and what hides them from it.
_IMPLIED = {
    "li": ({"li"}, _BLOCK - {"address", "div", "p"}),
    "dt": ({"dt", "dd"}, _BLOCK - {"address", "div", "p"}),
    "dd": ({"dt", "dd"}, _BLOCK - {"address", "div", "p"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
}
_CELL = {"td", "th", "caption", "table", "button"}
_TABLE = {"table", "tbody", "tfoot", "thead", "tr"} | _CELL
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_OUTSIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies",
    "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo",
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}


def _beside(attributes: str) -> bool:
    """The element's class, id or role names a part beside the article."""
    if not attributes:
        return False
    for found in _NAMED.finditer(attributes):
        value = next(x for x in found.groups() if x is not None)
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        if not _OUTSIDE.isdisjoint(_PART.findall(value)):
            return True
    return bool(_HIDDEN.search(attributes))


def lines(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, beside the article, in the marked article, characters in links) of each block of the page."""
    out: list[tuple[str, bool, bool, int]] = []
    run: list[str] = []
    links: list[str] = []
    #: Open elements: name, how what they hold counts (0 text, 1 beside, 2 header of an article), in an article.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: Counter[str] = Counter()
    at = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        linked = len(_SPACE.sub(" ", html.unescape("".join(links))).strip())
        run.clear()
        links.clear()
        if text:
            _, beside, inside = stack[-1]
            out.append((text, beside > 0, inside, min(linked, len(text))))

    def cut(place: int) -> None:
        if stack[place - 1][1:] != stack[-1][1:]:
            flush()
        for name, _, _ in stack[place:]:
            opened[name] -= 1
        del stack[place:]

    def find(names: set[str], hidden_by: set[str]) -> int:
        """Place of the innermost open element of these names, 0 if none is in reach."""
        if not any(opened[x] for x in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in hidden_by:
                break
        return 0

    while found := _TOKEN.search(page, at):
        run.append(page[at : found.start()])
        if opened["a"]:
            links.append(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                run.append(html.escape(found[0][9:-3]))
            continue
        name, close, attributes = name.lower(), bool(found[1] or found[4]), (found[3] or found[6] or "")
        if name in _BLOCK:
            flush()
        if name in _RAW:
            if not close and not attributes.endswith("/"):
                end = _ENDS[name].search(page, at)
                if end or name not in ("head", "title"):
                    at = end.end() if end else len(page)
            continue
        if close:
            # An inline end tag doesn't reach over a block, nor one inside a cell out of it.
            if name not in _VOID and (place := find({name}, set() if name in _TABLE else _CELL if name in _BLOCK else _BLOCK)):
                cut(place)
            continue
        if name in _BLOCK and name != "br" and (place := find({"p"}, _CELL)):
            cut(place)
        if name in _IMPLIED and (place := find(*_IMPLIED[name])):
            cut(place)
        if name in _VOID or attributes.endswith("/"):
            continue
        _, beside, inside = stack[-1]
        if name == "main":
            beside = 0
        elif beside == 2 and name in _HEADING:
            beside = 0
        elif beside == 2 and (name in _ASIDE or _beside(attributes)):
            beside = 1
        elif beside == 0 and (name in _ASIDE or (name not in ("html", "body") and _beside(attributes))):
            beside = 2 if name == "header" and inside else 1
        inside = beside == 0 and name in ("article", "main") or inside
        if (beside, inside) != stack[-1][1:]:
            flush()
        stack.append((name, beside, inside))
        opened[name] += 1
    run.append(page[at:] if not page[at:].startswith("<") else "")
    flush()
    return out


def kept(weights: list[int], threshold: int, window: int) -> list[bool]:
    """Whether each line lies between two dives that have a surge between them."""
    out = [False] * len(weights)
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    first = 0
    while first < len(weights):
        if sums[first] == 0:
            first += 1
            continue
        last = first
        while last < len(weights) and sums[last] > 0:
            last += 1
        if max(sums[first:last]) > threshold:
            out[first:last] = [True] * (last - first)
        first = last
    return out


def main_text(page: str | None, threshold: int = 86, window: int = 3) -> str:
    """Blocks of the main text, joined by line feeds."""
    if not page:
        return ""
    found = lines(page)
    plain = [0 if beside else len(text) - linked for text, beside, _, linked in found]
    weights = [n + (min(n, threshold // window) if inside else 0) for n, (_, _, inside, _) in zip(plain, found, strict=True)]
    keep = kept(weights, threshold, window)
    if not any(keep):
        keep = [w > 0 for w in weights]
    return "\n".join(text for (text, beside, _, _), k in zip(found, keep, strict=True) if k and not beside)


def extract(pages: DataFrame, threshold: int = 86, window: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, threshold, window) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_texts(spark, sf_dir: str) -> DataFrame:
    """Query op6_html: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
