"""What filters do to each other: each text is read once by a byte transducer, and all orders of the filters are told from counts.

The transducer is two tables. CLASS gives each byte its class, NEXT and EMIT give, for the state before a byte and its class, the
state after it and what is put out: the start of a word, the end of one, a code point, a capital or a symbol. Its state is told by the
byte before alone (whether that stood inside a word), so numpy takes all steps of a batch at once. The words that it marks go into
a hash table of (text, word) whose entries are compared byte by byte before two words count as one.

Failed filters of a document are bits of one integer. Documents are counted by part and integer, at most 2^filters rows a part; what
each filter removes in each order is a sum over these.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import field, fresh, whole, with_fields
from .words import SPACE_BYTES, bytes_of, mix, ranges, row_of, shards

SYMBOLS = "#$%&*|"
COMPARED = 1 << 20  # bytes of words compared at once
MEASURES = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"

OUTSIDE, INSIDE = 0, 1
SPACE, CAPITAL, SYMBOL, ASCII, LEAD, TAIL = range(6)
WORD, POINT, UPPER, SIGN, CLOSE = 1, 2, 4, 8, 16  # what a step puts out


def classes_of(symbols: str = SYMBOLS) -> np.ndarray:
    """The class of each byte: UTF-8 tails continue a code point, every other byte starts one."""
    table = np.full(256, ASCII, np.uint8)
    table[0x80:0xC0] = TAIL
    table[0xC0:] = LEAD
    table[ord("A"):ord("Z") + 1] = CAPITAL
    table[list(symbols.encode("ascii"))] = SYMBOL
    table[list(SPACE_BYTES)] = SPACE
    return table


#: State after a byte of each class, the same from both states: a word goes on until white space.
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
#: EMIT[state, class]
EMIT = np.array([[POINT, POINT | WORD | UPPER, POINT | WORD | SIGN, POINT | WORD, POINT | WORD, WORD],
                 [POINT | CLOSE, POINT | UPPER, POINT | SIGN, POINT, POINT, 0]], np.uint8)


class Transduced:
    """One pass over the bytes of some texts: counts per text, and the byte spans of all words."""

    def __init__(self, texts: pa.Array, classes: np.ndarray):
        self.raw, self.off = bytes_of(texts)
        kind = classes[self.raw]
        after = NEXT[kind]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        firsts = self.off[:-1][np.diff(self.off) > 0]
        before[firsts] = OUTSIDE  # each text starts outside
        out = EMIT[before, kind]
        self.starts = np.flatnonzero(out & WORD)
        lasts = self.off[1:][np.diff(self.off) > 0] - 1
        self.ends = np.union1d(np.flatnonzero(out & CLOSE), lasts[after[lasts] == INSIDE] + 1)
        # a text that ends inside a word closes there; no later byte may close it again
        self.words = self._per_text(self.starts)
        self.points, self.capitals, self.symbols = (self._sum(out, bit) for bit in (POINT, UPPER, SIGN))

    def _per_text(self, places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, self.off))

    def _sum(self, out: np.ndarray, bit: int) -> np.ndarray:
        full = np.diff(self.off) > 0
        sums = np.zeros(len(full), np.int64)
        if full.any():
            sums[full] = np.add.reduceat((out & bit) > 0, self.off[:-1][full], dtype=np.int64)
        return sums


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    longest = int((ends - starts).max())
    h = np.zeros(len(starts), np.uint64)
    left = np.arange(len(starts))
    for j in range(min(longest, 24)):
        left = left[starts[left] + j < ends[left]]
        h[left] = (h[left] + raw[starts[left] + j] + np.uint64(1)) * base
    if longest > 24:  # the rest of long words, byte pairs from the end, so that few passes are needed
        for j in range(1, 9):
            far = np.maximum(ends[left] - j, starts[left])
            h[left] = (h[left] + raw[far]) * base
    return mix(h ^ (ends - starts).astype(np.uint64))


def _same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of equal length at ``a`` and ``b`` hold the same bytes; some are compared at a time, long ones in pieces."""
    same = np.ones(len(a), bool)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(a):
        done = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, done + COMPARED, "right"))
        if hi <= lo:
            n = int(sizes[lo])
            same[lo] = all(np.array_equal(raw[a[lo] + k:a[lo] + min(k + COMPARED, n)], raw[b[lo] + k:b[lo] + min(k + COMPARED, n)])
                           for k in range(0, n, COMPARED))
            lo += 1
            continue
        differ = raw[ranges(a[lo:hi], sizes[lo:hi])] != raw[ranges(b[lo:hi], sizes[lo:hi])]
        same[lo:hi][row_of(sizes[lo:hi])[differ]] = False
        lo = hi
    return same


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which spans entered a table of (owner, bytes): one of each set of equal spans of an owner.

    Open addressing with twice as many slots as spans at least. In each round every span that is left looks at its slot: empty slots
    take one of those that want them; a span whose slot holds an equal one (owner, length and bytes are compared) is done; the
    others step to their next slot.
    """
    slots = 1 << max(4, int(2 * len(starts) - 1).bit_length())
    table = np.full(slots, -1, np.int64)
    at = mix(_span_hashes(raw, starts, ends) + mix(owner)) & np.uint64(slots - 1)
    at = at.astype(np.int64)
    entered = np.zeros(len(starts), bool)
    left = np.arange(len(starts))
    while len(left):
        free = left[table[at[left]] < 0]
        table[at[free]] = free
        entered[free[table[at[free]] == free]] = True
        left = left[~entered[left]]
        held = table[at[left]]
        sizes = ends[left] - starts[left]
        maybe = np.flatnonzero((owner[held] == owner[left]) & (ends[held] - starts[held] == sizes))
        equal = np.zeros(len(left), bool)
        equal[maybe] = _same_spans(raw, starts[left[maybe]], starts[held[maybe]], sizes[maybe])
        left = left[~equal]
        at[left] = (at[left] + 1) & (slots - 1)
    return entered


def counts_of(texts: pa.Array, classes: np.ndarray) -> list[np.ndarray]:
    """words, distinct words, capitals, code points and symbols of each text."""
    t = Transduced(texts, classes)
    owner = row_of(t.words)
    kept = distinct_spans(t.raw, t.starts, t.ends, owner)
    return [t.words, np.bincount(owner[kept], minlength=len(t.words)), t.capitals, t.points, t.symbols]


def measured(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, symbols: str = SYMBOLS) -> DataFrame:
    """The ``carry`` columns of ``docs`` with n_words, n_distinct, n_capitals, n_points and n_symbols of the whole text.

    Null counts as empty, which has none of these. Words are runs of bytes other than ASCII white space, told apart by case. Columns named
    like a result are replaced. An empty table gives no rows.
    """
    results = [f.split()[0] for f in MEASURES.split(", ")]
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in results]
    text = fresh(docs, "text")[0]
    table = classes_of(symbols)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in shards(batch, text):
                made = [pa.array(c, pa.int64()) for c in counts_of(texts, table)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], *made], names=[*keep, *results])

    return docs.select(*map(field, keep), whole(field(text_col)).alias(text)).mapInArrow(work, with_fields(docs, keep, MEASURES))


def audit(rows: DataFrame, letters: str, part: str = "part", failed: str = "failed", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    ``failed`` holds a document's failed filters, bit k for the k-th letter; ``good`` and ``toxic`` are booleans, null is false. A part has
    a row for each order and step, zeros included; an empty table gives none.
    """
    size = 1 << len(letters)
    masks = rows.groupBy(field(part).alias("part"), field(failed).cast("int").alias("m")).agg(
        F.count("*").alias("n"), F.count_if(field(good)).alias("g"), F.count_if(field(toxic)).alias("t"))
    per = masks.groupBy("part").agg(*(F.array(*(F.sum(F.when(F.col("m") == k, F.col(c)).otherwise(0)) for k in range(size))).alias(c)
                                      for c in "ngt"))
    steps = []
    for order in permutations(range(len(letters))):
        for k, own in enumerate(order):
            steps.append((("".join(letters[x] for x in order)), k + 1, 1 << own, sum(1 << x for x in order[:k])))
    plan = F.explode(F.array(*(F.struct(*map(F.lit, s)) for s in steps)))
    each = per.select("part", "n", "g", "t", plan.alias("s")).select(
        "part", "n", "g", "t", *(F.col(f"s.col{k + 1}").alias(x) for k, x in enumerate(("filter_order", "step", "own", "earlier"))))
    orders = len(steps) // len(letters)

    def over(column: str, which) -> F.Column:
        picked = F.transform(F.col(column), lambda x, m: F.when(which(m), x).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    before = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: fails(m) & ~before(m)
    # of the filters that a document fails, each comes first in equally many orders
    share = F.transform(F.col("n"), lambda x, m: F.when(fails(m), x * F.floor(F.lit(orders) / F.bit_count(m))).otherwise(0))
    return each.select(
        "part", "filter_order", "step", over("n", lambda m: ~before(m) & ~fails(m)).alias("kept"), over("n", removed).alias("removed"),
        over("n", lambda m: fails(m) & before(m)).alias("redundant"), over("n", lambda m: m == F.col("own")).alias("unique_fails"),
        over("g", removed).alias("good_lost"), over("t", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("shapley"))


#: What a document fails by its own measurements.
FILTERS = {"A": "n_words < 50", "B": "100 * n_distinct < 65 * n_words", "C": "100 * n_capitals > 5 * n_points", "D": "n_symbols > 0"}


def later_copies(rows: DataFrame, id_col: str, digest: str, out: str) -> DataFrame:
    """``rows`` with the boolean ``out``: whether a row with a smaller id has the same ``digest``.

    The join is on digest and id, so a large group of copies is dealt out by its ids. A null id is greater than every other one.
    """
    least = rows.groupBy(field(digest)).agg(F.min(field(id_col)).alias("__least"))
    other = least.select(field(digest).alias("__digest"), "__least", F.lit(False).alias(out))
    met = (field(digest) == F.col("__digest")) & field(id_col).eqNullSafe(F.col("__least"))
    return rows.join(other, met, "left").withColumn(out, F.coalesce(field(out), F.lit(True))).drop("__digest", "__least")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                 filters: Mapping[str, str] = FILTERS, copies: str | None = "E", symbols: str = SYMBOLS) -> DataFrame:
    """``audit`` of ``filters`` (letter: SQL condition over the measurements) and, as letter ``copies``, of texts that a smaller id has.

    Null texts are empty ones, and copies of each other; parts that are null count as the empty string. Labels that repeat an id hold if one of
    them does; ids without a label, and null ids, are neither good nor toxic. Rows that repeat an id and its text are copies of smaller ids
    only. An empty ``docs`` gives no rows.
    """
    told = docs.select(field(id_col).alias("id"), F.coalesce(field(part_col).cast("string"), F.lit("")).alias("part"),
                       F.sha2(whole(field(text_col)), 256).alias("digest"), field(text_col).alias("text"))
    rows = measured(told, "text", ["id", "part", "digest"], symbols)
    bits = F.lit(0)
    for k, condition in enumerate(filters.values()):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0))
    rows = durable(rows.select("id", "part", "digest", bits.alias("failed")))  # read twice below; the texts are read once
    if copies:
        rows = later_copies(rows, "id", "digest", "copy").withColumn(
            "failed", F.col("failed") + F.when(F.col("copy"), F.lit(1 << len(filters))).otherwise(F.lit(0)))
    held = labels.groupBy(field(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(rows.join(held, "id", "left"), "".join(filters) + (copies or ""))


def op13_byte_transducer(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
d as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
              100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), min(doc_id) over (partition by text) is not null)] as f
      from t left join l using (doc_id)),
m as (select part, f, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as t from d group by all),
x as (select unnest(range(1, 6)) as v),
o as (select [a.v, b.v, c.v, d.v, e.v] as o from x a, x b, x c, x d, x e where len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s as (select o, step, o[step] as own, o[1:step - 1] as earlier from o, (select unnest(range(1, 6)) as step) u),
r as (select part, s.o, step, own, n, g, t, f[own] as fails, len(list_filter(earlier, lambda e: f[e])) > 0 as gone, len(list_filter(f, lambda y: y)) as bad from m, s),
c as (select part, o, step, own, sum(n) filter (where not gone and not fails) as kept, sum(n) filter (where fails and not gone) as removed,
             sum(n) filter (where fails and gone) as redundant, sum(n) filter (where fails and bad = 1) as unique_fails,
             sum(g) filter (where fails and not gone) as good_lost, sum(t) filter (where fails and not gone) as toxic_lost from r group by all)
select part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i::bigint, 1)), 'string_agg', '') as filter_order, step::int as step,
       coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley
from c
"""
