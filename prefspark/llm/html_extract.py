"""Main text of web pages: block lines by markup, and template lines by differencing pages of near URLs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from prefspark.llm.common import slices
from prefspark.plans.session import materialize

# ---- markup ----

# Element names and the words of class and id names that mark what is not main text.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_CHROME = {
    "head", "nav", "footer", "aside", "form", "menu", "button", "select", "option", "datalist", "dialog", "svg", "math", "canvas",
    "object", "audio", "video", "map", "search", "label", "fieldset",
}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "note"}
_CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "aside", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer",
    "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "pagination", "pager", "toolbar", "skip", "outbrain", "taboola", "legal", "copyright", "disclaimer",
}
_NOT_NAMED = {"has", "with", "without", "no", "not", "is"}
_TITLE_WORDS = {"article", "entry", "post", "story"}
_MAIN_NAMES = {
    "content", "main-content", "maincontent", "article", "article-body", "article-content", "articlebody", "entry-content", "post-content",
    "post-body", "post", "story", "story-body", "page-content",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

CHROME, OPEN, NAMED, MAIN, ARTICLE = range(5)


def _names(attributes: dict[str, str]) -> list[str]:
    return [*attributes.get("class", "").split(), *attributes.get("id", "").split()]


def _zone(name: str, attributes: dict[str, str], around: int) -> int:
    """The zone that an element opens inside the zone `around`."""
    if around == CHROME or name in _CHROME:
        return CHROME
    if attributes:
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        if hidden or role in _CHROME_ROLES:
            return CHROME
        for written in _names(attributes):
            words = {w.lower() for w in _NAME_WORDS.findall(written)}
            if words & _CHROME_WORDS and not words & _NOT_NAMED and name not in ("html", "body", "main"):
                # An article may well be named for a widget it has; only comments are often articles themselves.
                if name != "article" or words & {"comment", "comments", "reply"}:
                    return CHROME
            if "header" in words and around < MAIN and not words & _TITLE_WORDS:
                return CHROME
        if role == "main":
            return max(around, MAIN)
        if attributes.get("itemprop", "").lower() == "articlebody":
            return ARTICLE
    if name == "header" and around < MAIN:
        return CHROME
    if name == "article":
        return ARTICLE
    if name == "main":
        return max(around, MAIN)
    if attributes and any(written.lower() in _MAIN_NAMES for written in _names(attributes)):
        return max(around, NAMED)
    return around


def page_lines(source: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block of a page that has text and is not menu, header, footer and the like.

    Character references are decoded, white space inside a block is one space. Broken markup is read like a
    browser does: an end tag closes what is open inside it, one without a start is ignored.
    """
    source = source or ""
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, at, n = OPEN, 0, len(source)
    held: list[str] = []

    def flush() -> None:
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                lines.append((zone, text))
            held.clear()

    while at < n:
        token = _TOKEN.search(source, at)
        upto = token.start() if token else n
        if upto > at and zone != CHROME:
            held.append(source[at:upto])
        if not token:
            break
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        elif name in ("td", "th"):
            held.append(" ")
        if token["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][1] != zone:
                        flush()
                    zone = stack[i][1]
                    del stack[i:]
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if stack and (stack[-1][0] == "p" and name in _BLOCK and name != "br" or stack[-1][0] == name == "li"):
            zone = stack.pop()[1]  # a block ends an open paragraph, an item the item before it
        rest = token["rest"]
        if name in _VOID or rest.endswith("/") and name in ("svg", "math"):
            continue
        if name in ("p", "li", "option", "b", "i", "em", "strong", "a", "span") and not rest.strip():
            # Without attributes these open no zone (an unclosed one may stay open), but option's list does.
            continue
        attributes = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else {}
        opened = _zone(name, attributes, zone)
        if name in ("p", "li", "b", "i", "em", "strong", "a", "span") and opened == zone:
            continue
        if opened != zone:
            flush()
        stack.append((name, zone))
        zone = opened
    flush()
    return [line for line in lines if line[0] != CHROME]


# ---- differencing ----


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the alignment: bit j of row i is 0 where the common subsequence of a[:i+1] grows at b[j]."""
    places: dict[int, int] = {}
    for j, value in enumerate(b):
        places[value] = places.get(value, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for value in a:
        match = row & places.get(value, 0)
        row = ((row + match) | (row - match)) & full
        out.append(row)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of `a` with every prefix of `b`."""
    row = _rows(a, b)[-1] if a else (1 << len(b)) - 1
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 100_000_000:
        # Too large to keep all rows: halve `a` and find where that halves `b`.
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows, out, j = _rows(a, b), [], len(b) - 1
    i = len(a) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`."""
    common = set(a) & set(b)
    kept_a = [i for i, value in enumerate(a) if value in common]
    return [kept_a[i] for i in _aligned([a[i] for i in kept_a], [v for v in b if v in common])]


def url_place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, in lower case; an unreadable one is a path without host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), (parts.path or "/").lower()
    except ValueError:
        return "", (url or "").lower()


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_HASHED = "page_id bigint, page_key bigint, host string, path string, lines array<bigint>"


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 16 << 20):
        rows = []
        for page, key, url, source in zip(*(c.to_pylist() for c in batch.columns)):
            lines = page_lines(source)
            hashes = [xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) for _, text in lines]
            rows.append((page, key, *url_place(url), hashes))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _HASHED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_PLACES = pa.schema([("at_host", pa.string()), ("at_body", pa.int64()), ("places", pa.list_(pa.int32()))])


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that each body shares with the nearer of its neighbours on the host."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            found = []
            for nth, other in enumerate((row["before"], row["after"])):
                if other is not None and other["host"] == row["host"]:
                    found.append((-_nearness(other["path"], row["path"]), nth, other["lines"]))
            places = shared_lines(row["lines"], min(found)[2]) if found else []
            out.append({"at_host": row["host"], "at_body": row["body"], "places": places})
        yield pa.RecordBatch.from_pylist(out, _PLACES)


def template_lines(pages: DataFrame) -> DataFrame:
    """(page_id, page_key, places): lines that pages share with their neighbour.

    Pages of a host with the same lines are copies, which tell nothing about each other's template: they are
    one body, in the place of the first of them. Bodies are put in the order of host and path by ranges, so
    that a host with a third of all pages is divided. Neighbours inside a range come from a window over it;
    the first and last body of each range, two rows per range, give the neighbours across. Lines travel as
    64-bit hashes.
    """
    hashed = materialize(pages.mapInArrow(_hashed, _HASHED).withColumn("body", F.xxhash64("lines")), "html-lines")
    order = ["host", "path", "page_id", "page_key"]
    bodies = hashed.groupBy("host", "body").agg(
        F.min(F.struct("path", "page_id", "page_key")).alias("place"), F.first("lines").alias("lines")
    )
    ranged = materialize(
        bodies.select("host", "place.*", "body", "lines").repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
        "html-bodies",
    )
    body = F.struct(*order, "lines")
    edges = ranged.groupBy("part").agg(F.min(body).alias("first"), F.max(body).alias("last"))
    by_part = W.orderBy("part")  # a row per range
    across = edges.select(
        "part", F.lag("last").over(by_part).alias("last_before"), F.lead("first").over(by_part).alias("first_after")
    )
    inside = W.partitionBy("part").orderBy(*order)
    paired = ranged.withColumn("before", F.lag(body).over(inside)).withColumn("after", F.lead(body).over(inside))
    shared = (
        paired.join(across, "part")
        .select(
            "host", "path", "body", "lines",
            F.coalesce("before", "last_before").alias("before"), F.coalesce("after", "first_after").alias("after"),
        )
        .mapInArrow(_places, "at_host string, at_body bigint, places array<int>")
        .where(F.size("places") > 0)
    )
    return (
        hashed.join(shared, (F.col("host") == F.col("at_host")) & (F.col("body") == F.col("at_body")))
        .groupBy("page_id", "page_key")
        .agg(F.min("places").alias("places"))
    )


def main_text(source: str | None, template: list[int] | None) -> str:
    """The blocks of the page's article, joined by line feeds.

    The innermost kind of container that the page has decides: article elements, else main elements, else
    elements named as content, else the body. Lines of the template go, but not from article elements.
    """
    lines, gone = page_lines(source), set(template or ())
    best = max((zone for zone, _ in lines), default=OPEN)
    left = [(zone, text) for i, (zone, text) in enumerate(lines) if zone == ARTICLE or i not in gone]
    return "\n".join(text for zone, text in left if zone == best)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 16 << 20):
        texts = [main_text(source, places) for source, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    Markup says what can be told from one page: menus, headers, footers, sidebars, notices, adverts, forms,
    scripts and comments go by element, role, class and id. What is left of every page is
    differenced against the page with the nearest URL path on its host: lines are aligned by longest
    common subsequence and shared ones are deleted; copies count as one page. A check follows: lines
    inside article elements come back, since passages that articles repeat are main text.

    Null html has empty text; pages without URL share the empty host; repeated rows get the same text; an
    empty table gives no rows; other columns are not read.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
        F.xxhash64(id_column, url_column, F.coalesce(F.col(html_column), F.lit(""))).alias("page_key"),
    )
    template = template_lines(rows.select("page_id", "page_key", "url", "html")).select(
        F.col("page_id").alias("of_id"), F.col("page_key").alias("of_key"), "places"
    )
    template = materialize(template, "html-template")
    joined = rows.join(template, rows.page_id.eqNullSafe(template.of_id) & (rows.page_key == template.of_key), "left")
    return joined.select("page_id", "url", "html", "places").mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
