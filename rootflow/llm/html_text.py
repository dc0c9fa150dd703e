"""Main text of web pages: nearest-URL page differencing over blocks of text.

Each page is read into blocks (what a block-level tag or a ``br`` separates); elements that hold no article
text are left out while reading: scripts, styles, forms, navigation, headers and footers of the page, asides,
and elements whose class, id or role names a menu, a notice, an advert, a sidebar or comments: a class that is such a
word, and outside an article also one that ends in such a word and names no content (``cookie-notice``, but neither
``share-price`` nor ``article-header``). If a page has an ``article`` or ``main`` element, only what lies in it counts.

Differencing. Within each host, pages are sorted by URL path, and each is paired with the neighbour whose path
has the longest common prefix with its own. The two pages' block lists are aligned by longest common
subsequence, and blocks they share are template, not article: both pages lose them. A pair that shares most of
the text left without the blocks that all near pages have (two different ones at least) is two copies of one
article, not two articles in one template; then the next neighbour is tried, and with none left nothing is deleted.
So a template may be longer than its articles. With one other near page, or where nothing is left, all text
is compared; three edited versions of one article with no other page near can't be told from a template. What lies in an element that marks an article is template only
if all near pages of the host (three at least) have it too: two articles may quote the same line.

Distribution. Pages are range-partitioned by (host, path, page_id, url, html) and sorted; a task streams through them
with a window of ``4 * REACH + 1`` pages, of which the nearest ``2 * REACH`` of the host are near pages, so a host with a
third of all pages is spread over tasks like any other. The few pages at the border of a range go on to a second
pass, which has both sides of each border; so a result doesn't depend on the number or place of ranges.

Defined results: null html is empty text; a null url is a host and path of its own (empty); rows that repeat a
page_id or url are pages each; a page without neighbours in its host is not differenced; an empty table gives
an empty result. Other columns are passed over.
"""

from __future__ import annotations

import html
import os
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootflow.llm.common import map_batches, parts_by_size

REACH = 2
#: Two pages that share at least this part of the smaller one's characters, without what all near pages have, are copies.
COPIES = 0.5
#: Near pages that have to agree before a block of a marked article is template.
SURE = 3
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without article text.
SKIPPED = frozenset("script style noscript template nav footer aside form button select option iframe svg canvas object head title menu dialog".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation navigational newsletter notice pagination pager popup privacy promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words of a class or id that name content, so what follows them names a part of it.
CONTENT = frozenset("article body content entry main page post section story text".split())
_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"])
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_CLOSES_P = BLOCKS - {"br"}


def _names_furniture(name: str, inside: bool) -> bool:
    if name.lower() in FURNITURE:
        return True
    found = [w.lower() for w in _WORDS.findall(name)]
    return not inside and bool(found) and found[-1] in FURNITURE and CONTENT.isdisjoint(found)


def _furniture(tag: str, attributes: str, inside: bool = False) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if any(_names_furniture(w, inside) for w in value.split()):
                return True
        elif name == "role":
            if value.lower() in _ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def blocks(source: str) -> tuple[list[str], bool]:
    """The page's blocks of visible text, in order, without furniture, and whether they lie in an element that marks an article."""
    everything: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, skipped so far, in an article so far
    found_article = False

    def flush() -> None:
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            everything.append((joined, bool(stack) and stack[-1][2]))
        text.clear()

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            if not (stack and stack[-1][1]):
                text.append(source[at:])
            break
        if m.start() > at and not (stack and stack[-1][1]):
            text.append(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and not (stack and stack[-1][1]):
                text.append(html.escape(m[1]))
            continue
        if m[2]:
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    # A stray end of an inline element doesn't close the blocks around it.
                    if tag in BLOCKS or tag in SKIPPED or all(s[0] not in BLOCKS for s in stack[k + 1 :]):
                        del stack[k:]
                    break
            continue
        if tag in BLOCKS:
            flush()
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or (tag == "li" and stack[k][0] == "li"):
                    del stack[k:]
                    break
                if stack[k][0] in ("div", "article", "section", "main", "body", "ul", "ol", "table", "td", "nav", "aside", "footer", "header", "form"):
                    break
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        skipped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag in ("article", "main") and not skipped:
            inside = found_article = True
        here = skipped or tag in SKIPPED or (tag == "header" and not inside) or _furniture(tag, m[4], inside)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if not here:
                text.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append((tag, here, inside))
    if text and not (stack and stack[-1][1]):
        flush()
    return [t for t, inside in everything if inside or not found_article], found_article


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path, without scheme, port, query and fragment."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", url or "").lstrip("/")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].partition(":")[0].lower(), "/" + path


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x with y[:0], y[:1], ..., y, by bits of whole numbers."""
    m = len(y)
    full = (1 << m) - 1
    places: dict[int, int] = {}
    for j, q in enumerate(y):
        places[q] = places.get(q, 0) | 1 << j
    v = full
    for p in x:
        u = v & places.get(p, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(-(-m // 8), "little"), np.uint8), count=m, bitorder="little")
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def _matched(x: list[int], y: list[int], at: int, out: list[int]) -> None:
    """Adds the places of x, counted from ``at``, that a longest common subsequence matches; memory grows with x and y, not their product."""
    a = 0
    while a < len(x) and a < len(y) and x[a] == y[a]:
        a += 1
    out.extend(range(at, at + a))
    x, y, at = x[a:], y[a:], at + a
    b = 0
    while b < len(x) and b < len(y) and x[-1 - b] == y[-1 - b]:
        b += 1
    out.extend(range(at + len(x) - b, at + len(x)))
    x, y = x[: len(x) - b], y[: len(y) - b]
    if not x or not y:
        return
    if len(x) == 1:
        out.extend([at] if x[0] in y else [])
        return
    half = len(x) // 2
    cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    _matched(x[:half], y[:cut], at, out)
    _matched(x[half:], y[cut:], at + half, out)


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a that a longest common subsequence with b matches."""
    # What only one side has can't match: the alignment runs over common blocks alone, by number.
    number = {t: i for i, t in enumerate(set(a) & set(b))}
    places = [i for i, t in enumerate(a) if t in number]
    out: list[int] = []
    _matched([number[a[i]] for i in places], [number[t] for t in b if t in number], 0, out)
    return {places[i] for i in out}


def differenced(page: list[str], near: list[list[str]], marked: bool = False, copies: float = COPIES) -> list[str]:
    """The page's blocks less those it shares with the first of its neighbours that isn't a copy of it.

    In a marked article a block has to be shared with all other near pages too, ``SURE`` at least."""
    # What all near pages have that aren't the same as this page; pages that are the same weigh as one.
    different = {tuple(x) for x in near if x and x != page}
    common = set(page).intersection(*different) if len(different) > 1 else set()
    if all(x in common for x in page):
        common = set()
    size = sum(len(x) for x in page if x not in common)
    for k, other in enumerate(near):
        gone = shared(page, other)
        # A page of nothing but template is no copy.
        left = sum(len(x) for x in other if x not in common) or size
        if sum(len(page[i]) for i in gone if page[i] not in common) >= copies * min(size, left):
            continue  # a copy, or nothing to compare with
        if marked and gone:
            rest = [set(x) for i, x in enumerate(near) if i != k]
            gone = {i for i in gone if len(near) >= SURE and all(page[i] in x for x in rest)}
        return [x for i, x in enumerate(page) if i not in gone]
    return page


_PAGE = "page_id long, url string, host string, path string, html string"
_EDGE = "range int, seq long, large boolean, head boolean, todo boolean, " + _PAGE
_EDGE_TYPES = [pa.int32(), pa.int64(), *[pa.bool_()] * 3, pa.int64(), *[pa.string()] * 4]
_TEXT = "page_id long, url string, text string, n_chars long"
_TEXT_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64()]
#: The field of a page in the stream that has its blocks.
_BLOCKS = 5


def _text_of(window: Sequence[tuple], k: int, reach: int, copies: float) -> str:
    """The text of the k-th page of a window of (page_id, url, host, path, html, blocks, marked)."""
    _, _, host, path, _, page, marked = window[k]
    places = sorted((abs(i - k), i) for i, o in enumerate(window) if i != k and o[2] == host and abs(i - k) <= 2 * reach)[: 2 * reach]
    near = [(-len(os.path.commonprefix([path, window[i][3]])), d, i) for d, i in places]
    return "\n".join(differenced(page, [window[i][_BLOCKS] for *_, i in sorted(near)], marked, copies))


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _ends(reach: int):
    """The first and last ``4 * reach`` pages of a range in order, the outer half of them to do; all pages of a small range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, near, edge, n = TaskContext.get().partitionId(), 2 * reach, 4 * reach, 0
        first: list[tuple] = []
        last: deque = deque(maxlen=edge)
        for page in _pages(batches):
            if n < 2 * edge:
                first.append(page)
            last.append(page)
            n += 1
        if n < 2 * edge:
            rows = [(part, k, False, False, True, *p) for k, p in enumerate(first)]
        else:
            rows = [(part, k, True, True, k < near, *p) for k, p in enumerate(first[:edge])]
            rows += [(part, n - edge + k, True, False, k >= edge - near, *p) for k, p in enumerate(last)]
        if rows:
            yield _batch(rows, _EDGE, _EDGE_TYPES)

    return run


def _inner(reach: int, copies: float):
    """The texts of a range's pages but for those that ``_ends`` has to do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, edge = 2 * reach, 4 * reach
        window: deque = deque()
        out: list[tuple] = []
        start = n = 0  # the number of the window's first page, and of pages so far
        done = near  # the next page that gets its text; in a small range none does
        for page in _pages(batches):
            window.append((*page, *blocks(page[4] or "")))
            n += 1
            while n >= 2 * edge and done < n - near:
                k = done - start
                text = _text_of(list(window)[k - near : k + near + 1], near, reach, copies)
                out.append((*window[k][:2], text, len(text)))
                done += 1
                if done - near > start:
                    window.popleft()
                    start += 1
            if len(out) >= 256:
                yield _batch(out, _TEXT, _TEXT_TYPES)
                out = []
        if out:
            yield _batch(out, _TEXT, _TEXT_TYPES)

    return run


def _borders(reach: int, copies: float):
    """Groups of neighbouring pages around borders, in order; the texts of those that are still to do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, todo = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            near = 2 * reach
            texts = [(window[k], _text_of(window[max(0, k - near) : k + near + 1], min(k, near), reach, copies)) for k in todo]
            if texts:
                yield _batch([(p[0], p[1], t, len(t)) for p, t in texts], _TEXT, _TEXT_TYPES)

        for b in batches:
            for group, wanted, page_id, url, host, path, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != key:
                    yield from close()
                    key, window, todo = group, [], []
                if wanted:
                    todo.append(len(window))
                window.append((page_id, url, host, path, source, *blocks(source or "")))
        yield from close()

    return run


def main_texts(pages: DataFrame, reach: int = REACH, copies: float = COPIES, ranges: int | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of (page_id, url, html)."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*:", ""), r"^/+", "")
    rest = F.regexp_extract(rest, r"^([^?#]*)", 1)
    place = F.regexp_extract(rest, r"^([^/]*)", 1)
    host = F.lower(F.regexp_extract(place, r"^(?:.*@)?([^:]*)", 1))
    path = F.concat(F.lit("/"), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    order = ["host", "path", "page_id", "url", F.xxhash64("html")]
    ordered = rows.repartitionByRange(ranges or parts_by_size(pages), *order).sortWithinPartitions(*order)
    # Both read the same shuffle; of its pages few are ends.
    found, edges = map_batches(ordered, _inner(reach, copies), _TEXT), map_batches(ordered, _ends(reach), _EDGE)
    # Ends of large ranges part the borders; small ranges between them hang together. A row for each range.
    large = edges.groupBy("range").agg(F.max(F.col("large").cast("int")).alias("n"))
    before = large.select(F.col("range").alias("of"), F.sum("n").over(Window.orderBy("range")).alias("border"))
    border = F.col("border") - (F.col("large") & F.col("head")).cast("int")
    edges = edges.join(F.broadcast(before), F.col("range") == F.col("of")).withColumn("border", border)
    edges = edges.repartition("border").sortWithinPartitions("border", "range", "seq").select("border", "todo", "page_id", "url", "host", "path", "html")
    return found.unionByName(map_batches(edges, _borders(reach, copies), _TEXT))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
