"""Main text of web pages: page structure, then differencing with the nearest pages of the same host.

1. A page is parsed into blocks of text in page order. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
   comments and the like are marked as furniture by their tags, roles and class names or ids. A name is a mark if it is one of MARKS as a whole,
   or made of marks and words of place only (site-header, sidebar-left); has-sidebar and notice-board aren't. A mark that holds more than half of
   the words of the articles (of the page, without one) isn't furniture but a wrapper, unless it is one of reader comments.
2. Differencing. Pages of a host are ordered by URL path. Each is aligned, by longest common subsequence of all lines, with its nearest page (the neighbour
   whose path shares the longer beginning; the earlier one on ties), then with the others of the two pages on either side. What it shares with all of
   them is furniture without telling marks: a passage that two or three articles quote is hardly on all five. In an article that goes
   only if no less stays; h1 never goes. With one other page on the host, an article loses the lines at its beginning and end that the other begins or
   ends with too, on the same condition; a body without article loses all shared lines. If nothing would be left, all stays: copies can't be told from a frame.
3. What stays of the article (or of the body, without one) is joined by single spaces.

Only hashes of lines travel between pages, then only the places of deleted lines. Neighbours come from one range sort; the
first and last two rows of its partitions meet in a table of four rows a partition, so no host is gathered in one task.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.llm.shared import discard, written

# HTML elements by what they mean for text.
SKIPPED = set("script style noscript template iframe svg canvas object embed math audio video select textarea button head title datalist".split())
FURNITURE = set("nav header footer aside form menu dialog fieldset".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("p div ul ol dl table section article h1 h2 h3 h4 h5 h6 blockquote pre form header footer nav aside main hr figure address details fieldset li dt dd".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
MARKS = set("""
ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
alert popup modal overlay sidebar aside comment comments commentlist disqus reply replies respond nav navbar navigation menu
breadcrumb breadcrumbs pagination pager header masthead footer colophon copyright share sharing social related recommended newsletter
subscribe subscription signup login toolbar widget skip tags
""".split())
PLACES = set("""
site page main top bottom left right upper lower first last box bar block list section wrapper wrap container area inner outer slot unit button buttons
link links icons text content item items global primary secondary mobile desktop fixed sticky inline post article entry user reader
""".split())
WHITE = re.compile(r"\s+")
REMARKS = set("comment comments commentlist disqus reply replies respond related".split())
CANDIDATE, ARTICLE, FLAGS = 1, 2, 2
TABLE_BITS = 1 << 26


def mark_of(name: str) -> str | None:
    """The mark that a class name or id is, or None."""
    if name in MARKS:
        return name
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]
    found = [x for x in parts if x in MARKS]
    return found[0] if found and all(x in MARKS or x in PLACES for x in parts) else None


def element_kind(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, str | None]:
    """(what an element makes of its text: 0 nothing, 1 article, 2 furniture, 3 no text; the mark of its class or id)."""
    if tag in SKIPPED:
        return 3, None
    if tag in FURNITURE and tag != "form":
        return 2, None
    if tag in ("html", "body"):
        return 0, None
    article, mark = tag in ("article", "main"), "form" if tag == "form" else None
    for name, value in attrs:
        value = (value or "").strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return 2, None
        if name in ("class", "id") and mark not in REMARKS:
            known = [m for m in map(mark_of, value.split()) if m]
            mark = next((m for m in known if m in REMARKS), None if article else (known or [mark])[0])
    return int(article), mark


class _Page(HTMLParser):
    """Blocks [text, article, furniture, marks, heading]: whether a block is in an article, surely furniture, which marked elements hold it, whether it is an h1."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool, bool, tuple[int, ...], bool]] = []
        self.marks: list[str] = []
        self.stack: list[tuple[str, int, int | None]] = []  # open elements, their kinds, their marks' numbers
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = WHITE.sub(" ", "".join(self.parts)).strip()
            if text:
                kinds = [k for _, k, _ in self.stack]
                self.blocks.append((text, 1 in kinds, 2 in kinds, tuple(m for *_, m in self.stack if m is not None), any(t == "h1" for t, *_ in self.stack)))
            self.parts = []

    def push(self, tag: str, kind: int, mark: str | None) -> None:
        if mark:
            self.marks.append(mark)
        self.stack.append((tag, kind, len(self.marks) - 1 if mark else None))

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag not in VOID:
                kind, mark = element_kind(tag, attrs)
                if kind > 1 or mark:
                    self.flush()
                    self.push(tag, kind, mark)
            return
        self.flush()
        if tag == "br":
            return
        if tag in CLOSES_P:
            n = len(self.stack)
            while n and self.stack[n - 1][0] in INLINE:
                n -= 1
            if n and self.stack[n - 1][0] == "p":
                del self.stack[n:]
        if self.stack and self.stack[-1][0] == "p" and tag in CLOSES_P:
            self.stack.pop()
        elif self.stack and tag == self.stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th"):
            self.stack.pop()
        if tag not in VOID:
            self.push(tag, *element_kind(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in INLINE:
            if self.stack and self.stack[-1][0] == tag:
                self.flush()
                self.stack.pop()
            return
        self.flush()
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag == "p" and any(k or m is not None for _, k, m in self.stack[i + 1 :]):
                    return
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not any(k == 3 for _, k, _ in self.stack):
            self.parts.append(data)


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """(text, kind, heading) of each block of a page in page order: kind 0 outside any article, 1 in an article, 2 furniture; heading: in an h1.

    Anything parses; what can't be read as markup is text. If marks leave no text at all, those of comments count no longer.
    """
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    found = page.blocks
    if not page.marks:
        return [(t, 2 if furniture else int(article), h1) for t, article, furniture, _, h1 in found]
    scope = any(article for _, article, *_ in found)
    words, total = [0] * len(page.marks), 0
    for t, article, _, marks, _ in found:
        if article or not scope:
            n = t.count(" ") + 1
            total += n
            for m in marks:
                words[m] += n
    for wrapper in (lambda m: page.marks[m] not in REMARKS and 2 * words[m] > total, lambda m: page.marks[m] in REMARKS or 2 * words[m] > total):
        void = {m for m in range(len(words)) if wrapper(m)}
        out = [(t, 2 if furniture or not void.issuperset(marks) else int(article), h1) for t, article, furniture, marks, h1 in found]
        if any(kind == scope for _, kind, _ in out):
            break
    return out


def line_hashes(found: list[tuple[str, int, bool]]) -> list[int]:
    """A number for each line: 62 bits of its hash, a bit for pages with an article, a bit for lines that may go."""
    main = int(any(kind == 1 for _, kind, _ in found))
    return [(xxhash.xxh3_64_intdigest(t.encode()) >> FLAGS << FLAGS | ARTICLE * main | CANDIDATE * (kind == main and not h1)) - (1 << 63) for t, kind, h1 in found]


def _lcs_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Rows of the table of longest common subsequences (Hyyrö's bits): row j has a 0 where b[:j] makes a longer one with a[: i + 1] than with a[:i]."""
    full, at = (1 << len(a)) - 1, {}
    for i, v in enumerate(a):
        at[v] = at.get(v, 0) | 1 << i
    row = full
    for v in b:
        u = row & at.get(v, 0)
        row = (row + u | row - u) & full
        yield row


def _lengths(row: int, n: int) -> np.ndarray:
    """Lengths of the longest common subsequence for each beginning of a, of one row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _lcs(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence. Large tables are split in halves of b (Hirschberg), so memory is linear."""
    head = next((i for i, (v, w) in enumerate(zip(a, b, strict=False)) if v != w), min(len(a), len(b)))
    rest = min(len(a), len(b)) - head
    tail = next((i for i in range(rest) if a[-1 - i] != b[-1 - i]), rest)
    out, ends, shift = list(range(head)), list(range(len(a) - tail, len(a))), head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return out + ends
    if len(a) * len(b) > TABLE_BITS and len(b) > 1:
        half, n = len(b) // 2, len(a)
        for first in _lcs_rows(a, b[:half]):
            pass
        for second in _lcs_rows(a[::-1], b[half:][::-1]):
            pass
        cut = int((_lengths(first, n) + _lengths(second, n)[::-1]).argmax())
        return out + [shift + i for i in _lcs(a[:cut], b[:half])] + [shift + cut + i for i in _lcs(a[cut:], b[half:])] + ends
    rows, found, i, j = list(_lcs_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> i - 1 & 1:
                i -= 1
                found.append(shift + i)
    return out + found[::-1] + ends


def common(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b."""
    both = set(a) & set(b)
    x = [i for i, v in enumerate(a) if v in both]
    return {x[i] for i in _lcs([a[i] for i in x], [v for v in b if v in both])}


def shared(own: list[int], other: list[int]) -> set[int]:
    """Places of a page's lines that may go and that it shares with another page, by alignment of all lines."""
    return {i for i in common([v >> FLAGS for v in own], [v >> FLAGS for v in other]) if own[i] & CANDIDATE}


def ends(own: list[int], other: list[int]) -> set[int]:
    """Places of the lines that may go with which both pages' articles begin, and of those with which both end."""
    a, b = [i for i, v in enumerate(own) if v & CANDIDATE], [v >> FLAGS for v in other if v & CANDIDATE]
    pairs = lambda x, y: next((k for k, (i, v) in enumerate(zip(x, y, strict=False)) if own[i] >> FLAGS != v), min(len(x), len(y)))
    head, tail = pairs(a, b), pairs(a[::-1], b[::-1])
    return {*a[:head], *a[len(a) - tail :]}


def furniture(own: list[int], others: list[list[int]]) -> list[int]:
    """Places of the lines to delete from a page, given the pages around it, the nearest first."""
    if not others or not own:
        return []
    article, may_go = own[0] & ARTICLE, sum(v & CANDIDATE for v in own)
    gone = ends(own, others[0]) if article and len(others) == 1 else shared(own, others[0])
    for other in others[1:]:
        if not gone:
            return []
        gone &= shared(own, other)
    return sorted(gone) if (2 * len(gone) <= may_go if article else len(gone) < may_go) else []


def without(found: list[tuple[str, int, bool]], gone: list[int] | None) -> str:
    """Main text of a page's blocks, without those at some places."""
    gone = set(gone or ())
    main = int(any(kind == 1 for _, kind, _ in found))
    return " ".join(t for i, (t, kind, _) in enumerate(found) if kind == main and i not in gone)


def main_text(html: str, *others: list[int]) -> str:
    """Main text of a page, given the lines of the pages around it, the nearest first."""
    found = blocks(html)
    return without(found, furniture(line_hashes(found), list(others)))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = [line_hashes(blocks(h)) for h in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.list_(pa.int64()))], ["page_id", "u", "host", "path", "lines"])


def _shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


Row = tuple[str, str, list[int]]  # host, path, lines


def nearest(own: Row, before: list[Row], after: list[Row]) -> list[list[int]]:
    """Lines of the pages around a page, the nearest first, of up to two rows before it and two behind (each side from the nearest on). Pages of other hosts and without lines tell nothing."""
    before, after = ([r for r in side if r[0] == own[0] and r[2]] for side in (before, after))
    if before and after and _shared_start(after[0][1], own[1]) > _shared_start(before[0][1], own[1]):
        before, after = after, before
    return [r[2] for k in (0, 1) for side in (before, after) for r in side[k : k + 1]]


SIDE = pa.list_(pa.struct([("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))]))
PAIRED = (("page_id", pa.int64()), ("u", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("before", SIDE), ("after", SIDE), ("gone", pa.list_(pa.int32())), ("edge", pa.int32()))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and path, each with the places of its lines to delete. The first and the last two rows of a partition are paired later:
    they carry their own lines and those of the rows beside them that this partition has. edge: 1 without the rows before, 2 without those behind, 3 both."""
    seen, out, at = [], [], 0  # the last rows, at most five, and the number of rows before them

    def row(k: int, last: bool) -> tuple:
        own, head = seen[k], at + k < 2
        before, after = seen[max(0, k - 2) : k][::-1], seen[k + 1 : k + 3]
        if not head and not last:
            return (*own[:4], None, None, None, furniture(own[4], nearest(own[2:], [r[2:] for r in before], [r[2:] for r in after])), 0)
        told = lambda side: [dict(zip(("host", "path", "lines"), r[2:], strict=True)) for r in side]
        return (*own, None if head else told(before), None if last else told(after), None, head + 2 * last)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), PAIRED, strict=True)], [n for n, _ in PAIRED])
        out.clear()
        return batch

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen.append(r)
            if len(seen) >= 3:
                out.append(row(len(seen) - 3, False))
            if len(seen) == 5:
                seen.pop(0)
                at += 1
            if len(out) >= 512:
                yield flush()
    out += [row(k, True) for k in range(max(0, len(seen) - 2), len(seen))]
    if out:
        yield flush()


def partners(pages: DataFrame) -> DataFrame:
    """(page_id, u, gone): places of the lines that a page shares with the pages around it on its host, by URL path.

    pages(page_id, u, host, path, html), u a hash that tells rows of one id apart.
    """
    lines = written(pages.mapInArrow(_lines, "page_id long, u long, host string, path string, lines array<long>"))  # the range sort reads them twice
    order = [F.col(c).asc_nulls_first() for c in ("host", "path", "page_id", "u")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    side = "array<struct<host: string, path: string, lines: array<long>>>"
    paired = written(ranged.mapInArrow(_paired, f"page_id long, u long, host string, path string, lines array<long>, before {side}, after {side}, gone array<int>, edge int"))
    discard(lines)
    edges = paired.where("edge > 0")
    w = W.orderBy(*order)  # four rows a partition of the range sort
    own = F.struct("host", "path", "lines")
    beside = lambda f, known: F.coalesce(known, F.filter(F.array(f(own, 1).over(w), f(own, 2).over(w)), lambda r: r.isNotNull()))
    met = edges.withColumns({"b": beside(F.lag, F.col("before")), "a": beside(F.lead, F.col("after"))})
    met = met.select("page_id", "u", "host", "path", "lines", "b", "a").mapInArrow(_edge_partner, "page_id long, u long, gone array<int>")
    return paired.where("edge = 0").select("page_id", "u", "gone").unionByName(met)


def _edge_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = lambda r: (r["host"], r["path"], r["lines"])
    for batch in batches:
        out = [(r["page_id"], r["u"], furniture(r["lines"], nearest(row(r), list(map(row, r["b"])), list(map(row, r["a"]))))) for r in batch.to_pylist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["page_id", "u", "gone"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            text = [without(blocks(h), g) for h, g in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Null and empty html give an empty text. A null url is a host of its own kind (no host): its pages are neighbours by id.
    Repeated rows stay, and are each other's neighbours. Extra columns are dropped.
    """
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("u", F.xxhash64("url", "html"))
    keyed = rows.select("page_id", "u", F.lower(F.substring_index(F.substring_index(address, "/", 1), "?", 1)).alias("host"), F.regexp_replace(F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1), r"/$", "").alias("path"), "html")
    found = partners(keyed).where("size(gone) > 0").groupBy("page_id", "u").agg(F.max("gone").alias("gone"))
    met = rows.join(found, rows["page_id"].eqNullSafe(found["page_id"]) & (rows["u"] == found["u"]), "left")
    return met.select(rows["page_id"], "url", "html", "gone").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
