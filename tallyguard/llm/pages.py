"""Main text of web pages by differencing each page with its nearest neighbour.

A page is cut into lines of text (one per block).  Pages of a host are ordered by URL path; the
nearest page is the neighbour in that order with the longer common path.  Lines that the
longest common subsequence aligns with the nearest page are shared: templates, menus, notices.

Shared lines are deleted, with two corrections where sharing alone is wrong for a page:
elements that HTML itself marks as no content (navigation, forms, adverts, reader comments and so
on, by their name or by a class, id or role of such words only) go even if their words differ from page to page, and lines inside an article element stay
even if a neighbour repeats them, as copied articles and licence lines do.  Lines outside the article
and not marked as no content stay unless they are shared.

Defined cases: a null or empty page has no text; a page without a URL belongs to the host '';
a page without an article element
whose every line that is not marked as no content is shared is a copy and loses none by sharing; rows with equal id, URL
and text have one result each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import map_slices, packed, unpacked

#: A quoted attribute value may hold ``>``; nothing is tried twice.
_ATTRIBUTES = r"""(?>=[\x20\x09-\x0D]*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[/!?a-zA-Z]" + _ATTRIBUTES + r">?|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that hold no content, and words of class, id or role that say so.
NO_CONTENT = frozenset("nav header footer aside form dialog menu head".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored banner cookie cookies consent notice popup modal sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments disqus share sharing social related newsletter subscribe promo promoted "
    "footer header masthead contentinfo complementary search dialog alert pagination".split()
)
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CONTAINERS = frozenset("div section ul ol table nav header footer aside form dialog menu head body main article figure dl details fieldset center".split())
#: Elements whose text is none of the page's.  The first two run to their end, or to that of the page; the others
#: to their end, if it comes before the next of their kind, else to the next tag.
RAW = frozenset("script style noscript template textarea title svg iframe select button".split())
TO_THE_END = frozenset(("script", "style"))
_ENDS = {name: re.compile(rf"</{name}[\x20\x09-\x0D]*>", re.I) for name in RAW}
_STARTS = {name: re.compile(rf"<{name}\b", re.I) for name in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marked(tag: str) -> bool:
    """Whether a class, id or role of a tag says that there is no content: all of its words do."""
    for _, a, b, c in _MARKS.findall(tag):
        for name in (a or b or c).lower().split():
            words = [w for w in _SPLIT.split(name) if w]
            if words and NO_CONTENT_WORDS.issuperset(words):
                return True
    return False


def _no_content(name: str, tag: str, inside: bool) -> bool:
    if name in NO_CONTENT and not (name == "header" and inside):
        return True
    return name not in ("body", "html", "article", "main") and _marked(tag)


def _tokens(page: str) -> Iterator[str]:
    """Tags, texts and comments of a page in order, without elements of ``RAW`` and what they hold."""
    at, missing = 0, set()
    while at < len(page):
        token = _TOKEN.match(page, at).group()
        at += len(token)
        tag = _TAG.match(token) if token[0] == "<" and len(token) > 1 else None
        name = tag.group(2).lower() if tag else ""
        yield token
        if name not in RAW or tag.group(1) or token.endswith("/>"):
            continue
        end = None if name in missing else _ENDS[name].search(page, at)
        if end is None:
            missing.add(name)  # nor is there one further on
        if name in TO_THE_END:
            at = end.end() if end else len(page)
        elif end and not _STARTS[name].search(page, at, end.start()):
            at = end.end()
        else:
            following = page.find("<", at)
            at = following if following >= 0 else len(page)


def lines(page: str) -> list[tuple[str, str]]:
    """(text, kind) of each block in page order; kind is 'article', 'none' (no content) or 'open'."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool]] = []  # open containers; whether each holds no content
    dropped = articles = 0
    marked = False  # whether the block at hand is marked itself

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, "none" if dropped or marked else "article" if articles else "open"))
            held.clear()

    for token in _tokens(page):
        if token[0] != "<" or token == "<":
            held.append(html.unescape(token))
            continue
        tag = _TAG.match(token)
        if tag is None:
            continue
        name = tag.group(2).lower()
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        marked = not tag.group(1) and name not in CONTAINERS and _marked(token)
        if name not in CONTAINERS:
            continue
        if not tag.group(1):
            if not token.endswith("/>"):
                stack.append((name, _no_content(name, token, articles > 0)))
                dropped += stack[-1][1]
                articles += name in ARTICLE
        elif any(open_ == name for open_, _ in stack):
            while True:
                closed, was = stack.pop()
                dropped -= was
                articles -= closed in ARTICLE
                if closed == name:
                    break
    flush()
    return out


#: Cells of the table of two lists of lines that are held at a time, as bits.
CELLS = 1 << 26


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    both = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    start = 0
    while start < min(len(left), len(right)) and a[left[start]] == right[start]:
        start += 1
    return set(left[:start]) | {left[start + k] for k in _subsequence([a[i] for i in left[start:]], right[start:])}


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit-parallel rows of the table: the zeros below a place count the common lines up to there."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _counts(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007 - the last one
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(b)].astype(np.int64))])


def _subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a``; long lists are halved where both halves share most, so memory stays bounded."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        middle = len(a) // 2
        split = int(np.argmax(_counts(a[:middle], b) + _counts(a[middle:][::-1], b[::-1])[::-1]))
        return _subsequence(a[:middle], b[:split]) + [middle + k for k in _subsequence(a[middle:], b[split:])]
    rows, full, j, found = list(_rows(a, b)), (1 << len(b)) - 1, len(b), []
    for k in range(len(a) - 1, -1, -1):
        # Step back where row k is needed.
        below = (1 << j) - 1
        before = rows[k - 1] if k else full
        if (~rows[k] & below).bit_count() > (~before & below).bit_count():
            found.append(k)
            while j and (rows[k] >> (j - 1)) & 1:
                j -= 1
            j -= 1
    return found[::-1]


def main_text(page: str, neighbour: list[int] | None) -> str:
    cut_up = lines(page)
    # The neighbour's lines come without those of its article.
    rest = [i for i, (_, kind) in enumerate(cut_up) if kind != "article"]
    shared = {rest[k] for k in common_lines(line_hashes([cut_up[i] for i in rest]), neighbour)} if neighbour else set()
    if len(rest) == len(cut_up) and all(i in shared for i in rest if cut_up[i][1] == "open"):
        shared = set()
    return "\n".join(text for i, (text, kind) in enumerate(cut_up) if kind == "article" or (kind == "open" and i not in shared))


def line_hashes(cut_up: list[tuple[str, str]]) -> list[int]:
    return [xxhash.xxh64_intdigest(text.encode()) - 2**63 for text, _ in cut_up]


PLACE = ("host", "path", "page_id", "key")


def _lined(keyed: DataFrame) -> DataFrame:
    """Place of each distinct page and the hashes of its lines that are not article text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = []
            for page in batch.column(4).to_pylist():
                cut_up = lines(page or "")
                hashes.append(line_hashes([x for x in cut_up if x[1] != "article"]))
            return pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(hashes, pa.list_(pa.int64()))], names=[*PLACE, "lines"])

        return each

    made = map_slices(keyed.select(*PLACE, "html"), make, "host string, path string, page_id long, key long, lines array<long>")
    return made.dropDuplicates(["key"])


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


MET = "key long, near int, before boolean, lines array<long>, edge int, host string, path string"


def nearest_lines(keyed: DataFrame) -> DataFrame:
    """``key`` and the lines of the nearest page of its host, for pages with a neighbour.

    A host may hold a third of all pages, so pages are sorted over range partitions; the
    first and last page of each partition, two rows, are paired in a second step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, first = TaskContext.get().partitionId(), None, True
        names = [f.split()[0] for f in MET.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.string()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, path, _, key, hashes = row
                if first:
                    out.append((key, None, None, hashes, 2 * number, host, path))
                    first = False
                if last is not None and last[0] == host:
                    near = _common(path, last[1])
                    out += [(key, near, True, last[4], None, None, None), (last[3], near, False, hashes, None, None, None)]
                last = row
            yield made(out)
        if last is not None:
            yield made([(last[3], None, None, last[4], 2 * number + 1, last[0], last[1])])

    placed = _lined(keyed).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).select(*PLACE, "lines")
    met = cut(placed.mapInArrow(run, MET), "page-neighbours")
    # Two rows a partition.
    order = Window.orderBy("edge")
    edges = met.where("edge is not null").select("edge", "key", "host", "path", "lines")
    beside = edges.select(
        "*", *(F.lag(c).over(order).alias(f"_{c}") for c in ("edge", "key", "host", "path", "lines"))
    ).where("edge % 2 = 0 and host = _host")

    @F.udf("int")
    def common(a, b):  # a few rows: two a partition
        return _common(a, b)

    near = common("path", "_path")
    ahead = beside.select("key", near.alias("near"), F.lit(True).alias("before"), F.col("_lines").alias("lines"))
    behind = beside.select(F.col("_key").alias("key"), near.alias("near"), F.lit(False).alias("before"), "lines")
    pairs = met.where("edge is null").select("key", "near", "before", "lines").unionByName(ahead).unionByName(behind)
    return pairs.groupBy("key").agg(F.max(F.struct("near", "before", "lines")).alias("best")).select("key", "best.lines")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` for every row of ``pages(page_id, url, html)``."""
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "").alias("path"),
        F.xxhash64("page_id", "url", "html", F.col("url").isNull(), F.col("html").isNull()).alias("key"),
    )
    near = nearest_lines(keyed).alias("n")
    carried = packed(keyed.withColumnRenamed("html", "text"), "page_id", "url", "key").alias("p")
    joined = carried.join(near, F.col("p.key") == F.col("n.key"), "left").select("p.page_id", "p.url", "n.lines", "p.packed")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [
                main_text(unpacked(blob).decode(), neighbour)
                for neighbour, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return each

    return map_slices(joined, make, "page_id long, url string, text string")
