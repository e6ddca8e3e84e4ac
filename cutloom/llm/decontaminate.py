"""Benchmark passages in training texts, found by suffix arrays of the training shards.

Each task cuts its rows into shards of a few megabytes, sorts the suffixes of a shard by their words (prefix doubling) and
looks each suffix of each test item up by binary search: lower and upper bound give all places where its window occurs. Windows
that follow each other on one diagonal join to the longest verbatim match. Nothing is shuffled; the items come as blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words
from .columns import ascii_lower, field, fresh, whole, with_fields

WINDOW = 10
BLOCK_CHARS = 4_000_000
RESULTS = {"n_words": "long", "n_hit": "long", "items": "array<string>", "longest_words": "long", "longest_start": "long",
           "longest_item": "string"}


class Items:
    """Test items as word sequences: their distinct windows by width, and which item has a window where."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        w = words.Words(words.text_array(pa.array(texts, pa.string())), words.ALNUM)
        self.ids, self.vocabulary = np.array(ids, dtype=object), w.vocabulary
        first, self.groups = np.cumsum(w.counts) - w.counts, []
        widths = np.minimum(w.counts, window)
        for width in sorted(set(widths[widths > 0].tolist())):
            chosen = np.flatnonzero(widths == width)
            many = w.counts[chosen] - width + 1
            place = words.ranges(np.zeros(len(chosen), np.int64), many)
            start = np.repeat(first[chosen], many) + place
            rows = w.codes[start[:, None] + np.arange(width)]
            windows, which = np.unique(rows, axis=0, return_inverse=True)
            by = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which.ravel()[by], np.arange(len(windows) + 1))
            self.groups.append((width, windows, bounds, np.repeat(chosen, many)[by], place[by]))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next ``depth`` tokens (or more); tokens are small non-negative integers."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    rank, known = tokens, 1
    top = int(tokens.max()) + 1
    if top < 1 << 20:  # three tokens fit one 64-bit key
        padded = np.concatenate([tokens, np.zeros(2, np.int64)])
        rank, known = (padded[:n] << 40) | (padded[1:n + 1] << 20) | padded[2:n + 2], 3
    order = np.argsort(rank, kind="stable")
    while True:
        fall = np.concatenate([[0], np.cumsum(rank[order][1:] != rank[order][:-1])])
        if known >= depth or fall[-1] == n - 1:
            return order
        dense = np.empty(n, np.int64)
        dense[order] = fall
        later = np.concatenate([dense[known:] + 1, np.zeros(min(known, n), np.int64)])
        rank, known = dense * (n + 1) + later, 2 * known
        order = np.argsort(rank, kind="stable")


def bounds(tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all rows of ``wanted`` at once: the first suffix not below (or, if ``upper``, above) each."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
    padded = np.concatenate([tokens, np.full(wanted.shape[1], -1)])
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        sign = np.zeros(len(wanted), np.int8)
        for k in range(wanted.shape[1]):
            sign = np.where(sign == 0, np.sign(padded[at + k] - wanted[:, k]), sign)
        right = open_ & ((sign < 0) | (upper & (sign == 0)))
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def find(texts: pa.Array, items: Items, window: int) -> tuple:
    """Word counts, positions of hit words, items and the longest match of each text of one shard."""
    found = words.Words(texts, words.ALNUM)
    n = len(texts)
    row = words.row_of(found.counts)
    tokens = np.zeros(len(found.codes) + n, np.int64)  # 0 ends a text
    place = np.arange(len(found.codes)) + row
    tokens[place] = found.codes + 1
    start = np.cumsum(found.counts + 1) - found.counts - 1
    order = suffix_array(tokens, window)
    known = pc.index_in(items.vocabulary, value_set=found.vocabulary)
    known = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    cover = np.zeros(len(tokens) + 1, np.int64)
    hit_rows, hit_items, runs = [], [], []
    for width, windows, group, of_item, at_word in items.groups:
        wanted = known[windows]
        there = np.flatnonzero((wanted > 0).all(1))
        if not len(there) or not len(order):
            continue
        low, high = (bounds(tokens, order, wanted[there], up) for up in (False, True))
        pos = order[words.ranges(low, high - low)]
        which = np.repeat(there, high - low)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + width, -1)
        many = group[which + 1] - group[which]
        entry = words.ranges(group[which], many)
        pos = np.repeat(pos, many)
        hit_rows.append(np.searchsorted(start, pos, "right") - 1)
        hit_items.append(of_item[entry])
        runs.append((hit_rows[-1], hit_items[-1], pos, pos - at_word[entry], np.full(len(pos), width)))
    covered = np.flatnonzero(np.cumsum(cover[:-1]))
    cut = np.searchsorted(covered, start)
    hit = [covered[a:b] - s for a, b, s in zip(cut, np.append(cut[1:], len(covered)), start)]
    lists: list[list[str]] = [[] for _ in range(n)]
    longest = [(None, None, None)] * n
    if any(map(len, hit_rows)):
        pairs = np.unique(np.stack([np.concatenate(hit_rows), np.concatenate(hit_items)]), axis=1)
        for r, i in pairs.T:
            lists[r].append(items.ids[i])
        r, i, pos, diagonal, width = (np.concatenate(x) for x in zip(*runs))
        by = np.lexsort((pos, diagonal, i, r))
        r, i, pos, diagonal, width = r[by], i[by], pos[by], diagonal[by], width[by]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(r))) + width[first] - 1
        best = np.lexsort((items.ids[i[first]].astype(str), pos[first], -length, r[first]))
        lead = best[np.concatenate([[True], np.diff(r[first][best]) > 0])]
        for k in lead:
            at = first[k]
            longest[r[at]] = (int(length[k]), int(pos[at] - start[r[at]]), items.ids[i[at]])
    return found.counts, hit, [sorted(x) for x in lists], longest


def _search(docs: DataFrame, text_col: str, block: tuple[list[str], list[str]], window: int, carry: list[str],
            places: bool = False) -> DataFrame:
    """The results for one block of items; with ``places``, also the positions of the hit words."""
    item_ids, item_texts = block
    kinds = RESULTS | ({"places": "array<long>"} if places else {})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(item_ids, item_texts, window)
        for batch in batches:
            for part, texts in words.shards(batch, text_col):
                counts, hit, lists, longest = find(texts, items, window)
                made = [pa.array(counts, pa.int64()), pa.array([len(x) for x in hit], pa.int64()),
                        pa.array(lists, pa.list_(pa.string())), pa.array([x[0] for x in longest], pa.int64()),
                        pa.array([x[1] for x in longest], pa.int64()), pa.array([x[2] for x in longest], pa.string())]
                if places:
                    made.append(pa.array(hit, pa.list_(pa.int64())))
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays(kept + made, names=[*carry, *kinds])

    schema = with_fields(docs, carry, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    return docs.select(*map(field, dict.fromkeys([*carry, text_col]))).mapInArrow(scan, schema)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[tuple[list[str], list[str]]]:
    """The items in blocks of about ``limit`` characters, each read for itself; an item without an id or words takes no part."""
    items = benchmark.select(field(id_col).cast("string").alias("id"), ascii_lower(whole(field(text_col))).alias("text"))
    items = items.where("id is not null").withColumn("size", F.length("text"))
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    many = max(1, -(-total // limit))
    out = []
    for k in range(many):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(many)) == k).select("id", "text").distinct().collect()
        out.append(([r.id for r in rows], [r.text for r in rows]))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) with the benchmark passages found in the text.

    A window is ``window`` words of an item in a row, or the whole item if it is shorter. n_words counts the words, n_hit those
    inside an occurrence of a window, items lists the items with such windows (sorted as text); longest_words, longest_start and
    longest_item tell the longest verbatim match (earliest, then smallest item, on ties; null if none). Null and empty texts
    have no words and no hits, on either side; repeated rows are each searched; columns named like a result are replaced; an
    empty table gives no rows.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in RESULTS]
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    if len(blocks) == 1:
        return _search(docs, text_col, blocks[0], window, carry)
    (row,) = fresh(docs, "row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    inside = [_search(numbered, text_col, b, window, [row], places=True) for b in blocks]
    found = inside[0]
    for more in inside[1:]:
        found = found.unionByName(more)
    match = F.struct((-F.col("longest_words")).alias("l"), F.col("longest_start").alias("s"), F.col("longest_item").alias("i"))
    order = F.min(F.when(F.col("longest_words").isNotNull(), match))
    merged = found.groupBy(row).agg(
        F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), order.alias("best"))
    best = {"longest_words": -F.col("best.l"), "longest_start": F.col("best.s"), "longest_item": F.col("best.i")}
    return numbered.join(merged, row, "left").withColumns(best).select(*map(field, carry), *RESULTS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with the columns of ``docs``."""
    (hit,) = fresh(docs, "hit")
    named = docs.withColumnsRenamed({c: f"{hit}{k}" for k, c in enumerate(docs.columns)})
    text = named.columns[docs.columns.index(text_col)]
    clean = find_passages(named, benchmark, text, **options).where("n_hit = 0")
    return clean.select(*(field(f"{hit}{k}").alias(c) for k, c in enumerate(docs.columns)))


def op10_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest_words", "longest_start", "longest_item")


OP10_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select item_id, j - 1 as q, least(10, len(w)) as k, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') as g
  from iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(j) where len(w) > 0),
sizes as (select distinct k from win),
spots as (
  select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as g
  from dw, sizes, unnest(range(1, len(w) - k + 2)) u(p)),
occ as (select doc_id, p, spots.k, item_id, q from spots join win on spots.g = win.g and spots.k = win.k),
hit as (select distinct doc_id, x from (select distinct doc_id, p, k from occ), unnest(range(p, p + k)) u(x)),
runs as (
  select doc_id, item_id, p, k, p - q as d,
         p - row_number() over (partition by doc_id, item_id, p - q order by p) as isle from occ),
len as (select doc_id, item_id, min(p) - 1 as s, count(*) + min(k) - 1 as l from runs group by doc_id, item_id, d, isle),
best as (select doc_id, l, s, item_id from len
         qualify row_number() over (partition by doc_id order by l desc, s, cast(item_id as varchar)) = 1),
its as (select doc_id, count(distinct item_id) as n,
               string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as j from occ group by doc_id)
select d.doc_id, coalesce(len(w), 0) as n_words, (select count(*) from hit where hit.doc_id = d.doc_id) as n_hit,
       coalesce(n, 0) as n_items, sha256(coalesce(j, '')) as items_sha256, n is not null as contaminated,
       best.l as longest_words, best.s as longest_start, cast(best.item_id as varchar) as longest_item
from dw d left join its on d.doc_id = its.doc_id left join best on d.doc_id = best.doc_id
"""
