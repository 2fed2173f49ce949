"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element. Lines in a part of the page that is no article by its element or
class (menus, banners, adverts, notices, forms, reader comments, footers) are left out. A line weighs as many characters as it
has outside links, and weights are summed over a sliding window of lines: where a sum first rises to `surge` characters a dense
run begins, and where sums last fall below it the run ends. The text goes from the first such point to the last, and all lines
between are kept, and so are headings and paragraphs right before and after. Where a page marks articles (outermost article or main elements), these points choose among them: those
with a dense run are kept from their first line to their last, so that no heading or short paragraph of one is lost; marked
parts without one are kept if they link nowhere, and go if they do, as teasers. A page, or a page's marked articles, without any dense run is kept from the first to
the last line with weight.

Defined results: a null or empty html gives an empty text; repeated rows, null ids, empty tables and further columns make no
difference, but a column of the result's name gives way to it; pages are parsed whole, also when they end in the middle of a tag
or leave elements open.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements whose content is never text of a page.
SKIPPED = frozenset("head title script style noscript template svg math iframe object canvas audio video select button textarea datalist".split())
#: Elements that are no part of an article. A header may be one within an article (its headline).
NOT_ARTICLE = frozenset("nav footer aside form menu dialog".split())
#: What a head can hold; any other element ends one that is left open.
IN_HEAD = frozenset("head title base link meta style script noscript template".split())
#: Words in a class, id or role that mark what is no part of an article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|nav(?:bar|igation)?|menu|breadcrumbs?|"
    r"sidebar|aside|related|recommended|recommendations|trending|sharing|social|footer|foot|masthead|comments?|commentlist|replies|reply|respond|disqus|widget|toolbar|pagination|pager|complementary|contentinfo|dialog|hidden|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Of an article or main element only these say that it is none.
_REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|discussion|disqus|related|recommended|promo|sponsored|ads?)(?:$|[\s_-])", re.I)
#: Words about the layout of a page, such as has-sidebar, and about the state of a part of it, such as comments-open, mark nothing.
_LAYOUT = re.compile(r"(?<![\w-])(?:(?:has|with|no|without|is)[-_][\w-]*|[\w-]*[-_](?:open|opened|closed|enabled|disabled|allowed|on|off)(?![\w-]))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words for places and boxes, which an id may have beside what it marks.
PLACES = frozenset("main top bottom left right side upper lower inner outer site page global primary secondary box block area container wrapper wrap section panel region list bar unit slot inline head header content form link links item items".split())
#: What a line near dense text begins with if it belongs to it.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
#: Elements of which none can be in another of their kind.
NO_NEST = frozenset("p dt dd option".split())
#: Elements that end an open one of the same kind.
SELF_ENDING = frozenset("p li dt dd option tr td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:/?[A-Za-z](?:[^<>"']|"[^"]*"|'[^']*')*(?:>|\Z)|[/!?][^>]*(?:>|\Z)|[A-Za-z/][^>]*(?:>|\Z))""", re.S)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s/>=])|\saria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


def _says(marks: re.Pattern, kind: str, value: str) -> bool:
    """Whether a class, id or role says that its element is no part of an article. An id names one thing: all of its words must fit."""
    value = _LAYOUT.sub("", value)
    if not marks.search(value):
        return False
    return kind != "id" or all(marks.fullmatch(w) or w.lower() in PLACES or w.isdigit() for w in re.split(r"[\s_-]+", value) if w)


def lines_of(page: str) -> tuple[list[str], list[int], list[int], list[str]]:
    """(lines, weights (-1: in no article by its element or class), the number of the marked article that holds each, or 0, the block elements that began them)."""
    lines: list[str] = []
    weights: list[int] = []
    inside: list[int] = []
    began: list[str] = []
    block = ""
    text: list[str] = []
    linked = [0]
    zone, depth = "", 0  # the element that is left out, and how often it is nested
    article, link, marks = 0, 0, 0

    def flush(weighs: bool) -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append(line)
                weights.append(max(len(line) - linked[0], 0) if weighs else -1)
                inside.append(marks if article and weighs else 0)
                began.append(block)
            text.clear()
        linked[0] = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not (zone in SKIPPED):
            text.append(piece)
            if link:
                linked[0] += len(" ".join(html.unescape(piece).split()))
        if not m:
            break
        at, tag = m.end(), m.group()
        named = _NAME.match(tag)
        if not named:
            continue
        name = named.group(1).lower()
        closes = tag[1] == "/"
        if zone:
            if name == zone:
                depth += -depth if zone in NO_NEST and not closes else -1 if closes else 0 if zone in SELF_ENDING else 1
            elif zone == "head" and name not in IN_HEAD or zone == "p" and not closes and name not in INLINE or closes and name in ("article", "main", "body"):
                depth = 0
            if depth <= 0:
                flush(False)
                ended, zone = zone, ""
                if ended == name and closes:
                    continue
            else:
                if name not in INLINE and zone not in SKIPPED:
                    flush(False)
                continue
        if name == "a":
            link = 0 if closes else 1
        if name in INLINE:
            continue
        flush(True)
        link, block = 0, "" if closes else name
        if closes:
            if name in ("article", "main"):
                article = max(article - 1, 0)
            continue
        if name in VOID or tag.endswith("/>") and name not in SKIPPED:
            continue
        marks_of = _REMARKS if name in ("article", "main") else MARKED
        marked = any(_says(marks_of, kind.lower(), x or y or z) for kind, x, y, z in _MARKS.findall(tag)) and name not in ("html", "body")
        if name in SKIPPED or name in NOT_ARTICLE or marked or name == "header" and not article or _HIDDEN.search(tag):
            zone, depth = name, 1
            if name in ("script", "style", "textarea", "title"):  # their content is no markup
                close = re.compile(rf"</{name}\b", re.I).search(page, at)
                at = close.start() if close else end
        elif name in ("article", "main"):
            marks += not article
            article += 1
    flush(not zone)
    return lines, weights, inside, began


def dense(weights: np.ndarray, window: int, surge: int) -> np.ndarray:
    """Whether each line stands between a surge and the next dive: it has weight, and a window with it has `surge` characters."""
    n = len(weights)
    if not n:
        return np.zeros(0, bool)
    sums = np.convolve(weights, np.ones(window, int))[: n + window - 1]  # sums[i]: the lines i-window+1 to i
    return np.array([weights[i] > 0 and sums[i : i + window].max() >= surge for i in range(n)], bool)


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The lines between surges and dives, joined by line feeds."""
    if not page:
        return ""
    lines, weights, inside, began = lines_of(page)
    own = np.array(weights, np.int64)
    marked = np.array(inside, np.int64)
    if marked.any():
        runs = np.zeros(len(own), bool)
        for k in np.unique(marked[marked > 0]):  # windows end at the bounds of an article
            at = np.flatnonzero(marked == k)
            runs[at] = dense(own[at], window, surge)
        some = np.unique(marked[runs]) if runs.any() else np.unique(marked[marked > 0])
        # a short article, unlike a teaser, leads nowhere
        short = [k for k in np.unique(marked[marked > 0]) if all(weights[i] == len(lines[i]) for i in np.flatnonzero(marked == k))]
        return "\n".join(x for x, k in zip(lines, np.isin(marked, [*some, *short]), strict=True) if k)
    text = np.flatnonzero(dense(np.maximum(own, 0), window, surge))
    if not len(text):  # a short page
        text = np.flatnonzero(own > 0)
    if not len(text):
        return ""
    # headings and paragraphs next to the dense text, down to the page's rights, are of it
    near = lambda i: 0 <= i < len(lines) and own[i] > 0 and began[i] in TEXT_BLOCKS and not _RIGHTS.match(lines[i])
    first, last = int(text[0]), int(text[-1])
    while near(first - 1):
        first -= 1
    while near(last + 1):
        last += 1
    while last > first and _RIGHTS.match(lines[last]):
        last -= 1
    return "\n".join(x for x, k in zip(lines[first : last + 1], weights[first : last + 1], strict=True) if k >= 0)


def extract(pages: DataFrame, source: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each row's html in a further column."""
    pages = pages.drop(into)
    schema = T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([main_text(x.as_py()) for x in b.column(b.schema.get_field_index(source))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, into])

    return pages.mapInArrow(of, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).selectExpr("page_id", "url", "text", "cast(char_length(text) AS bigint) AS n_chars")
