"""Main text of HTML pages: what differencing a page with its nearest URL leaves, checked against the marks of its tags.

Every page is cut into lines, one for each block, menus and footers too. Pages of a host that have lines outside an article are
ordered by path, query and row; a page is paired with the neighbour whose path and query share the longest beginning (of equals the
one before). Exact copies, which have the same lines, are one page there. Pages of an article alone are paired likewise among all pages of the host. The lines of both are aligned by longest common subsequence
and shared lines are deleted: they are the site's, not the page's. The marks follow as a check: shared lines inside a marked
article come back, since articles share sentences and may be copies of each other, and lines left outside of it, or in marked menus,
footers, adverts and the like, go.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words
from .columns import field, fresh, hash_pair, whole, with_fields

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)"
    r"(?:>|(?=<)|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
#: Elements whose content is never text; it ends at their own end tag.
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video annotation annotation-xml".split())
#: Elements that are not the article, with all they hold.
ASIDE = frozenset("nav header footer aside form button select dialog menu head figcaption fieldset".split())
#: Those that are part of it inside an article, and elements that no name of theirs marks there.
KEPT = frozenset("header figcaption".split())
PLAIN = KEPT | frozenset("h1 h2 h3 h4 h5 h6 hgroup figure caption math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr br "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
ARTICLE = frozenset(("article", "main"))
#: Words of class, id or role names that mark what is not the article.
MARKED = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                   "disclaimer disqus feedback footer header login masthead menu modal nav navbar navigation newsletter notice notices "
                   "notification pagination popup promo promoted promotion recommended related replies reply respond share sharing "
                   "sidebar signup social sponsor sponsored subscribe subscription toolbar widget contentinfo complementary search".split())
#: Inside an article only class and role count, each name as a whole: ids come from headings.
TOKENS = re.compile(r"(?<![\w-])(?:class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
LINK_SHARE = 0.8  # outside an article, a block with this share of linked text is a menu


def _marked(tag: str, attrs: str, article: bool) -> bool:
    if article:
        return tag not in PLAIN and any(t in MARKED for m in TOKENS.finditer(attrs) for t in (m[1] or m[2] or m[3] or "").lower().split())
    return any(p.lower() in MARKED for m in NAMES.finditer(attrs) for p in PARTS.findall(m[1] or m[2] or m[3] or ""))


def blocks_of(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article) of the blocks of a page in order, without what is marked as not the article."""
    return [(text, kind == INSIDE) for text, kind in lines_of(page) if kind != FRAME]


INSIDE, LOOSE, FRAME = "inside", "loose", "frame"


def lines_of(page: str) -> list[tuple[str, str]]:
    """(text, kind) of all blocks of a page in order: in an article, outside of one, or marked as not the article."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    marked: list[str] = []  # text of the open marked element
    size = linked = 0
    skip: list[str] = []  # open elements from the marked one on; empty outside
    article = link = at = 0

    def plain(joined: str) -> str:
        return " ".join((entities.unescape(joined) if "&" in joined else joined).split())

    def close() -> None:
        nonlocal size, linked
        joined = "".join(text)
        if joined:
            clean = plain(joined)
            if clean:
                out.append((clean, INSIDE if article else LOOSE if linked < LINK_SHARE * size else FRAME))
            text.clear()
        size = linked = 0

    def close_marked() -> None:
        if marked:
            clean = plain("".join(marked))
            if clean:
                out.append((clean, FRAME))
            marked.clear()

    def put(piece: str) -> None:
        nonlocal size, linked
        text.append(piece)
        size += len(piece.strip())
        linked += len(piece.strip()) if link else 0

    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            if skip:
                marked.append(page[at:m.start()])
            else:
                put(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        end = bool(m["end"])
        if not end and tag in RAW:
            done = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = done.end() if done else len(page)
            continue
        if skip:
            if tag not in INLINE:
                close_marked()
            if end and tag in skip:
                while skip.pop() != tag:
                    pass
            elif not end and (tag in ARTICLE or tag == "body") and article == 0 and "article" not in skip:
                skip.clear()  # what stood open was never closed
            elif not end and tag not in VOID:
                skip.append(tag)
            if not skip:
                close_marked()
            if skip or tag not in ARTICLE or end:
                continue
        if tag == "a":
            link = 0 if end else 1
        elif tag == "br":
            text.append(" ")
        if tag in INLINE:
            if not end and tag not in VOID and _marked(tag, m["attrs"], article > 0):
                skip.append(tag)
            continue
        close()
        link = 0 if tag != "a" else link
        if tag in ARTICLE:
            article = max(0, article - 1) if end else article + 1
        if not end and tag not in VOID and tag not in ("body", "html"):
            own = tag in ASIDE and not (tag in KEPT and article)
            if own or tag not in ARTICLE and _marked(tag, m["attrs"], article > 0):
                skip.append(tag)
    if at < len(page):
        if skip:
            marked.append(page[at:])
        else:
            put(page[at:])
    close_marked()
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; bit-parallel, a row of len(b) bits per line of ``a``."""
    spots: dict[int, int] = {}
    for k, line in enumerate(b):
        spots[line] = spots.get(line, 0) | 1 << k
    full = (1 << len(b)) - 1
    state, rows = full, []
    for line in a:
        met = state & spots.get(line, 0)
        state = ((state + met) | (state - met)) & full
        rows.append(state)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not (i and not rows[i - 1] >> (j - 1) & 1):
            out.append(i)
            j -= 1
    return out[::-1]


def _line_hash(lines: list[str]) -> list[int]:
    return pd.util.hash_array(pd.Series(lines, dtype=object).to_numpy(), categorize=False).view("int64").tolist() if lines else []


def _lines(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(row, host, path, query, framed, lines): hashes of the lines of each page; is one of them outside of an article?"""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(page) for page in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array([any(kind != INSIDE for _, kind in x) for x in found], pa.bool_()),
                 pa.array([_line_hash([t for t, _ in x]) for x in found], pa.list_(pa.int64()))], names=["row", "host", "path", "query", "framed", "lines"])

    url = F.coalesce(field(url_col).cast("string"), F.lit(""))
    named = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "//")
    bare = F.regexp_replace(named, "(?s)[?].*$", "")
    rows = pages.select(
        _row(pages).alias("row"), F.lower(F.regexp_extract(bare, "^//(?:[^/@]*@)?([^/:]*)", 1)).alias("host"),
        F.regexp_replace(bare, "^//[^/]*", "").alias("path"), F.regexp_extract(named, "(?s)[?].*$", 0).alias("query"), whole(field(html_col)).alias("html"))
    return rows.mapInArrow(scan, "row struct<a:long,b:long>, host string, path string, query string, framed boolean, lines array<long>")


def _row(pages: DataFrame):
    return hash_pair(*map(field, pages.columns))


PLACE = ("host", "path", "query")


def _neighbours(pages: DataFrame) -> DataFrame:
    """``pages`` with before, after: the pages next to each in URL order that are no copies of it, whatever the size of a host.

    Copies in a row are one run. Runs are numbered over all partitions of one range sort; one row per partition is all that the
    driver sees.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = [batch.column(batch.schema.get_field_index("print")).field(k).to_numpy() for k in range(2)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = (prints[0][1:] != prints[0][:-1]) | (prints[1][1:] != prints[1][:-1])
            new[0] = last != (prints[0][0], prints[1][0])
            last = (prints[0][-1], prints[1][-1])
            run = runs + np.cumsum(new)
            runs = int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(run, pa.int64())],
                                             names=[*batch.schema.names, "part", "run"])

    marked = pages.withColumn("print", hash_pair(F.col("host"), F.col("lines")))
    order = marked.repartitionByRange(*PLACE, "row").sortWithinPartitions(*PLACE, "row")
    told = durable(order.mapInArrow(number, with_fields(marked, marked.columns, "part int, run long")))
    ends = told.groupBy("part").agg(F.max("run").alias("runs"), F.min_by("print", "run").alias("first"), F.max_by("print", "run").alias("last"))
    start, ahead, last = {}, 0, None
    for r in ends.orderBy("part").collect():  # one row per partition
        ahead -= r["first"] == last  # its first run goes on from the partition before
        start[r["part"]], last = ahead, r["last"]
        ahead += r["runs"]
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.lit(None).cast("map<int,int>")
    ranked = told.withColumn("n", F.element_at(offset, F.col("part")).cast("long") + F.col("run")).drop("part", "run", "print")
    runs = durable(ranked.groupBy("n").agg(
        F.min(F.struct(*PLACE, "row", "lines")).alias("first"), F.max(F.struct(*PLACE, "row")).alias("last")))

    def beside(by: int, end: str, name: str) -> DataFrame:
        near = F.struct(f"{end}.host", f"{end}.path", f"{end}.query", "first.lines")
        return runs.select((F.col("n") + by).alias("n"), near.alias(name))

    both = ranked.join(beside(1, "last", "before"), "n", "left").join(beside(-1, "first", "after"), "n", "left")
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    return both.drop("n").withColumns({"before": same("before"), "after": same("after")})


def _shared(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _deletions(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(row, gone): the lines of pages that the page with the nearest URL has as well."""
    lines = durable(_lines(pages, html_col, url_col)).where("size(lines) > 0 and concat(host, path, query) <> ''")
    pairs = _neighbours(lines.where("framed"))
    if not lines.where("not framed").isEmpty():  # no partners of the others: they have no frame to share
        pairs = pairs.unionByName(_neighbours(lines).where("not framed"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for path, query, own, *sides in zip(*(c.to_pylist() for c in batch.columns[1:])):
                best = max((s for s in sides if s and s["lines"]), key=lambda s: _shared(path + query, s["path"] + s["query"]), default=None)
                gone.append(common_lines(own, best["lines"]) if best else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])

    found = pairs.select("row", "path", "query", "lines", "before", "after").mapInArrow(align, "row struct<a:long,b:long>, gone array<int>")
    return durable(found.where("size(gone) > 0").dropDuplicates(["row"]))


MADE = ("main_text", "n_shared", "n_restored")


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``pages`` (all by default) with main_text, n_shared and n_restored.

    Lines that a page shares with its nearest page are deleted (n_shared); then the marks of tags are checked, which give lines of
    an article back (n_restored) and take marked frames away.

    Blocks of the main text in page order, joined by an empty line; character references are decoded, white space inside a block
    is one space. A page without a marked article gives what differencing and marks leave; if all were shared, nothing is deleted. Null and
    empty pages give an empty text. Pages without a URL have no neighbours. Pages of one URL, or of one path, are neighbours of
    each other unless they are copies; equal rows get equal results. Columns named like the new ones are replaced. An empty table gives no rows.
    """
    pages = pages.drop(*MADE)
    carry = [c for c in (pages.columns if carry is None else carry) if c.lower() not in MADE]
    row, gone = fresh(pages, "row", "gone")
    dropped = _deletions(pages, html_col, url_col).withColumnsRenamed({"row": row, "gone": gone})
    both = pages.withColumn(row, _row(pages)).join(dropped, row, "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            html, cuts = (batch.column(batch.schema.get_field_index(c)) for c in (html_col, gone))
            made, shared, restored = [], [], []
            for page, cut in zip(html.cast(words.FIELD).fill_null("").to_pylist(), cuts.to_pylist()):
                lines, cut = lines_of(page), set(cut or ())
                inside = {k for k, (_, kind) in enumerate(lines) if kind == INSIDE}
                loose = {k for k, (_, kind) in enumerate(lines) if kind == LOOSE}
                if not inside and len(cut) == len(lines):
                    cut = set()  # all shared: a copy, not a frame
                kept = inside or loose - cut or loose  # what was deleted of an article is back
                made.append("\n\n".join(lines[k][0] for k in sorted(kept)))
                shared.append(len(cut))
                restored.append(len(inside & cut))
            yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(made, pa.string()), pa.array(shared, pa.int64()), pa.array(restored, pa.int64())],
                                             names=[*carry, *MADE])

    wanted = dict.fromkeys([*carry, html_col, gone])
    return both.select(*map(field, wanted)).mapInArrow(scan, with_fields(pages, carry, "main_text string, n_shared long, n_restored long"))


def op4_page_differencing(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, carry=["page_id", "url"]).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "n_shared", "n_restored")
