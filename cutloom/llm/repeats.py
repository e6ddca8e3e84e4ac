"""Passages that recur across documents, by a sparse suffix array.

Suffixes are kept only at minimiser positions: where the hash of WIDTH words is the least of GAP neighbouring ones. Any passage
of WIDTH + GAP - 1 words therefore holds a kept suffix with at least WIDTH of its words, in every document it occurs in. Suffixes
whose first WIDTH words occur in one document only are dropped by counts; the others are sorted by what follows, over all
partitions, and each is compared with the nearest ones of other documents before and after it. A match is extended to the left
and to the right; one that reaches the least length is reported, and overlapping matches of a document are joined.

The order follows the words to the right first, so a third document may share a passage that neither neighbour shares. Such passages of
LEAST words, as far as they lie in no match found so far and need no more words to the right than the nearest suffixes share, are
looked up among those around all suffixes of the same key, by hash, ranges of them first: each passage of LEAST words that another
document holds is found or lies in a match, whatever lies between the two.

Words are compared by hash, the first WIDTH by 64 bits, those of the extensions by 32 bits each; open passages by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from . import words
from .columns import field
from .slots import likely_held

LEAST = 50  # words of a passage
WIDTH = 26
GAP = LEAST - WIDTH + 1
SIDE = LEAST - WIDTH  # words of context on either side of the first WIDTH; the next kept suffix is nearer than that
CHUNK_ROWS = 1 << 15
BLOCK = 256  # words
STEP = 5  # passages of a range
NO_NUMBER, NO_NAME = -1 << 63, "\x00null"  # what stands for a null id, so that least and greatest ids of a group see it


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` values in a row."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    rest = width - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` values in a row, by doubling: a pair's hash from its halves'."""
    parts, have, out, start = h, 1, None, 0
    left = width
    while left:
        if left & 1:
            piece = parts[start:]
            out = piece if out is None else words.mix(out[:len(piece)] * BASE + piece)
            start += have
        left >>= 1
        if left:
            parts = words.mix(parts[:-have] * BASE + parts[have:])
            have *= 2
    n = len(h) - width + 1
    return out[:n]


def kept_suffixes(counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, key) of the minimiser positions of each text; texts shorter than LEAST have none."""
    text_of, at, key = [], [], []
    ends = np.cumsum(counts)
    for k in np.flatnonzero(counts >= LEAST):
        grams = window_hashes(h[ends[k] - counts[k]:ends[k]], WIDTH)
        least = _slide(grams, GAP, np.minimum)
        padded = np.concatenate([np.zeros(GAP - 1, np.uint64), least, np.zeros(GAP - 1, np.uint64)])
        chosen = np.flatnonzero(_slide(padded, GAP, np.maximum) == grams)
        text_of.append(np.full(len(chosen), k))
        at.append(chosen)
        key.append(grams[chosen])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(text_of), np.concatenate(at), np.concatenate(key)


def _suffixes(docs: DataFrame, context: bool) -> DataFrame:
    """(key, doc) of the kept suffixes, with ``context`` also their place and the words around them. ``docs`` has doc, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.shards(batch, "text"):
                w = words.Words(texts, words.BY_SPACE)
                h = w.hashes()
                text, at, key = kept_suffixes(w.counts, h)
                doc = part.column(0).take(pa.array(text))
                if not context:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), doc], names=["key", "doc"])
                    continue
                first = np.cumsum(w.counts) - w.counts
                low = np.concatenate([(h >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.uint32)])
                for start in range(0, len(at), 1 << 16):
                    block = slice(start, start + (1 << 16))
                    place, begin, size = (first[text] + at)[block], first[text][block], w.counts[text][block]
                    around = []
                    for steps in (-1 - np.arange(SIDE), WIDTH + np.arange(SIDE)):
                        spot = place[:, None] + steps
                        inside = (spot >= begin[:, None]) & (spot < (begin + size)[:, None])
                        around.append(np.where(inside, low[np.where(inside, spot, len(low) - 1)], 0))
                    left, right = ([r.tobytes() for r in x] for x in around)
                    before = np.minimum(at[block], SIDE)
                    after = np.minimum(size - at[block] - WIDTH, SIDE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[block].view(np.int64)), doc.slice(start, 1 << 16), pa.array(at[block]),
                         *(pa.array(x, pa.int32()) for x in (before, after)), *(pa.array(x, pa.binary()) for x in (left, right))],
                        names=["key", "doc", "at", "n_left", "n_right", "left", "right"])

    kind = docs.schema["doc"].dataType.simpleString()
    more = ", at long, n_left int, n_right int, left binary, right binary" if context else ""
    return docs.mapInArrow(scan, f"key long, doc {kind}{more}")


def _agree(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from the first on, up to ``most``."""
    return np.minimum(np.cumprod(a == b, axis=1).sum(1), most)


def _around(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words to the left and to the right of each suffix, nearest first."""
    return tuple(np.frombuffer(b"".join(rows[c].to_pylist()), np.uint32).reshape(rows.num_rows, SIDE) for c in ("left", "right"))


def _fits(n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Which passages of LEAST words lie within so many words: a row per suffix, a column per number of words to its left."""
    s = np.arange(SIDE + 1)
    return (s <= n_left[:, None]) & (SIDE - s <= n_right[:, None])


def _side_hashes(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Hashes of the nearest 0, 1, .. SIDE words on either side."""
    sides = []
    for words_ in (left, right):
        h = np.zeros((len(words_), SIDE + 1), np.uint64)
        for k in range(SIDE):
            h[:, k + 1] = words.mix(h[:, k] * BASE + words_[:, k] + np.uint64(1))
        sides.append(h)
    return sides


def _mixed(key: np.ndarray, left: np.ndarray, right: np.ndarray, columns: np.ndarray) -> np.ndarray:
    near = words.mix(left * BASE + right + columns.astype(np.uint64))
    return words.mix(near ^ key.view(np.uint64)[:, None]).view(np.int64)


def _passage_hashes(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the passages of LEAST words around each suffix, in the columns of _fits."""
    before, after = _side_hashes(left, right)
    return _mixed(key, before, after[:, ::-1], np.arange(SIDE + 1))


def _matches(rows: pa.Table, open_end: bool) -> tuple[pa.Table, int, np.ndarray]:
    """Matches of sorted suffixes with the nearest ones of other documents, how many rows they settle, and the passages left open.

    The last document's rows wait for what comes after them, unless ``open_end`` says that nothing does. Open passages are bits
    in the order of _fits.
    """
    n = rows.num_rows
    key, at, n_left, n_right = (rows[c].to_numpy() for c in ("key", "at", "n_left", "n_right"))
    left, right = _around(rows)
    code = rows["doc"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], code[1:] != code[:-1]])
    first = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    settled = n if open_end else int(first[-1])
    best, span = np.zeros(n, np.int64), np.stack([at, at, np.zeros(n, np.int64)], 1)  # start, end, partner
    open_ = _fits(n_left, n_right)
    most_right = np.zeros(n, np.int64)  # of all suffixes of the key, the nearest in order share most words to the right
    for other in (first[block] - 1, np.append(first[1:], n)[block]):
        seen = (other >= 0) & (other < n)
        most_right[~seen] = SIDE
        ok = np.flatnonzero(seen)
        ok = ok[key[ok] == key[other[ok]]]
        o = other[ok]
        l = _agree(left[ok], left[o], np.minimum(n_left[ok], n_left[o]))
        r = _agree(right[ok], right[o], np.minimum(n_right[ok], n_right[o]))
        total = l + r + WIDTH
        good = total >= LEAST
        open_[ok] &= ~_fits(l, r)
        most_right[ok] = np.maximum(most_right[ok], r)
        span[ok[good], 0] = np.minimum(span[ok, 0], at[ok] - l)[good]
        span[ok[good], 1] = np.maximum(span[ok, 1], at[ok] + WIDTH + r)[good]
        more = good & (total > best[ok])
        best[ok[more]] = total[more]
        span[ok[more], 2] = o[more]
    open_ &= SIDE - np.arange(SIDE + 1) <= most_right[:, None]
    hit = np.flatnonzero(best)
    out = pa.table({"doc": rows["doc"].take(pa.array(hit)), "first": span[hit, 0], "last": span[hit, 1],
                    "other": rows["doc"].take(pa.array(span[hit, 2]))})
    return out, settled, open_ @ (1 << np.arange(SIDE + 1))


EDGE = ("key", "at", "n_left", "n_right", "left", "right")


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """Rows (doc, first, last, other) of matches; with ``part`` set, the suffixes at the borders of partitions; with ``open`` set,
    those whose neighbours leave passages open."""
    kind = suffixes.schema["doc"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.Table | None = None  # the row before the open block, and the open block
        place = 0
        known = 0  # rows of held that were told before

        def left_open(rows: pa.Table, bits: np.ndarray, stop: int) -> pa.RecordBatch:
            some = known + np.flatnonzero(bits[known:stop])
            return shaped(rows.take(pa.array(some)).append_column("open", pa.array(bits[some], pa.int32())))

        def edges(rows: pa.Table) -> pa.RecordBatch:
            nonlocal place
            place += rows.num_rows
            return shaped(rows.append_column("part", pa.array([part] * rows.num_rows, pa.int32())).append_column(
                "i", pa.array(range(place - rows.num_rows, place), pa.int64())))

        def first_block(rows: pa.Table) -> pa.Table:
            codes = rows["doc"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            return rows.slice(0, int(np.argmax(codes != codes[0])) if (codes != codes[0]).any() else rows.num_rows)

        told = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < CHUNK_ROWS:
                continue
            if not told:
                yield edges(first_block(held))
                told = True
            found, settled, bits = _matches(held, False)
            yield shaped(found)
            yield left_open(held, bits, settled)
            if settled:
                held, known = held.slice(settled - 1), 1
        if held is not None:
            if not told:
                yield edges(first_block(held))
            found, settled, bits = _matches(held, True)
            yield shaped(found)
            yield left_open(held, bits, settled)
            back = first_block(held.take(pa.array(np.arange(held.num_rows)[::-1])))
            yield edges(back.take(pa.array(np.arange(back.num_rows)[::-1])))

    columns = {"doc": None, "first": pa.int64(), "last": pa.int64(), "other": None, "part": pa.int32(), "i": pa.int64(), "key": pa.int64(),
               "at": pa.int64(), "n_left": pa.int32(), "n_right": pa.int32(), "left": pa.binary(), "right": pa.binary(),
               "open": pa.int32()}

    def shaped(rows: pa.Table) -> pa.RecordBatch:
        kind_ = rows["doc"].type
        full = [rows[c].combine_chunks() if c in rows.column_names else pa.nulls(rows.num_rows, t or kind_) for c, t in columns.items()]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in full], names=list(columns))

    return suffixes.mapInArrow(scan, f"doc {kind}, first long, last long, other {kind}, part int, i long, key long, at long, "
                                     "n_left int, n_right int, left binary, right binary, open int")


def _ranges_of(wanted: np.ndarray) -> np.ndarray:
    """Which ranges of STEP numbers of words to the left hold a passage that is wanted."""
    return np.stack([wanted[:, low:low + STEP].any(1) for low in range(0, SIDE + 1, STEP)], axis=1)


def _wanted(rows: pa.RecordBatch) -> np.ndarray:
    """The passages of each row in the columns of _fits: all that fit, or with ``open`` those left open of them."""
    wanted = _fits(rows["n_left"].to_numpy(), rows["n_right"].to_numpy())
    if "open" in rows.schema.names:
        wanted &= (rows["open"].to_numpy()[:, None] >> np.arange(SIDE + 1) & 1).astype(bool)
    return wanted


def _ranged(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` with ``range`` and ``core``: a row per range of STEP passages that has a wanted one.

    The passages of a range have the same least number of words to the left and to the right; ``core`` is the hash of these and the key, so
    two suffixes can share a passage of a range only if they have its core in common.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 13):
                rows = batch.slice(start, 1 << 13)
                left, right = _side_hashes(*_around(rows))
                low = np.arange(0, SIDE + 1, STEP)
                most = np.minimum(low + STEP - 1, SIDE)
                core = _mixed(rows["key"].to_numpy(), left[:, low], right[:, SIDE - most], low)
                row, k = np.nonzero(_ranges_of(_wanted(rows)))
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(row)).columns, pa.array(k, pa.int32()), pa.array(core[row, k])],
                                                 names=[*rows.schema.names, "range", "core"])

    return suffixes.mapInArrow(scan, T.StructType(suffixes.schema.fields + T.StructType.fromDDL("range int, core long").fields))


def _passages(ranged: DataFrame) -> DataFrame:
    """(passage, doc, first): the hashes of the wanted passages of each row's range."""
    kind = ranged.schema["doc"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 13):
                rows = batch.slice(start, 1 << 13)
                key, at = rows["key"].to_numpy(), rows["at"].to_numpy()
                wanted = _wanted(rows) & (np.arange(SIDE + 1) // STEP == rows["range"].to_numpy()[:, None])
                row, s = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_passage_hashes(key, *_around(rows))[row, s]), rows["doc"].take(pa.array(row)), pa.array(at[row] - s)],
                    names=["passage", "doc", "first"])

    return ranged.mapInArrow(scan, f"passage long, doc {kind}, first long")


def _joined(matches: DataFrame) -> DataFrame:
    """(doc, first, last, other): matches that overlap or touch become one. Dealt out by document once."""
    by_doc = Window.partitionBy("doc").orderBy("first", "last")
    fresh_ = F.coalesce(F.col("first") > F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    told = matches.repartition("doc").groupBy("doc", "first", "last").agg(F.min("other").alias("other")).withColumn("new", fresh_.cast("int"))
    return told.withColumn("n", F.sum("new").over(by_doc)).groupBy("doc", "n").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("other").alias("other")).drop("n")


def _bits(low: Column, high: Column) -> Column:
    """The bits from low to high of those that _fits has."""
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(SIDE))
    return F.when(low > high, 0).otherwise(F.call_function("shiftleft", F.lit(1), (high + 1).cast("int")) - F.call_function(
        "shiftleft", F.lit(1), low.cast("int")))


def _not_reported(open_: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``open_``, and maybe a few more, with a passage outside the joined matches of their document: finding the others again
    tells nothing new.

    A passage holds the word of its suffix, and joined matches are apart: at most one match has to be looked at, found by blocks of words.
    """
    spans = known.select("doc", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("last") - 1) / BLOCK))).alias("block"))
    narrow = open_.select("doc", "at", "open", F.floor(F.col("at") / BLOCK).alias("block"))
    both = narrow.alias("o").join(spans.alias("k"), F.expr("o.doc = k.doc and o.block = k.block and k.first <= o.at and o.at < k.last"), "left")
    inside = F.when(F.col("k.first").isNotNull(), _bits(F.col("at") + LEAST - F.col("last"), F.col("at") - F.col("first"))).otherwise(F.lit(0))
    left = both.where(F.col("open").bitwiseAND(F.bitwise_not(inside)) != 0).select("o.doc", "at")
    return likely_held(open_, durable(left), ["doc", "at"])


def _held_elsewhere(open_: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Matches (doc, first, last, other) of the passages left open that any other document holds.

    Of the suffixes only those with the key of an open one are looked at, of their passages only ranges whose core an open one has, and of
    these only passages that are open somewhere. Passages are then counted by their least and greatest document.
    """
    asked = durable(_ranged(open_))
    near = likely_held(_ranged(likely_held(suffixes, open_, ["key"])), asked, ["core"])
    open_passages = durable(_passages(asked))
    held = likely_held(_passages(near), open_passages, ["passage"])
    holders = durable(held.groupBy("passage").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b"))
    told = likely_held(open_passages, holders, ["passage"])
    return told.join(holders, "passage").select(
        "doc", "first", (F.col("first") + LEAST).alias("last"), F.when(F.col("a") == F.col("doc"), F.col("b")).otherwise(F.col("a")).alias("other"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words, other): the passages of at least LEAST words of a document that others hold as well.

    Words are runs without ASCII white space, A-Z lower-cased; ends are exclusive; other is the least id met in a match.
    Passages that recur inside one document only are not reported, and rows that repeat an id are one document; rows with a null
    id are one document too, whose id and ``other`` are null. The least 64-bit number, and the text NO_NAME, stand for null and are
    no ids of their own. Null and short texts have no passages. Other columns play no part. An empty table gives no rows.
    """
    kind = docs.select(field(id_col)).schema[0].dataType
    whole_number = isinstance(kind, T.IntegralType)
    nobody = F.lit(NO_NUMBER if whole_number else NO_NAME)
    doc = F.coalesce(field(id_col).cast("bigint" if whole_number else "string"), nobody)
    narrow = docs.select(doc.alias("doc"), field(text_col).alias("text"))
    keys = _suffixes(narrow, False).groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    order = ["key", "right", "left", "doc", "at"]
    shared = durable(likely_held(_suffixes(narrow, True), durable(keys.where("a <> b").select("key")), ["key"]))
    found = durable(_neighbours(shared.repartitionByRange(*order).sortWithinPartitions(*order)))
    edges = found.where("part is not null").repartition(1).sortWithinPartitions("part", "i").select("doc", *EDGE)
    known = durable(_joined(found.where("last is not null").select("doc", "first", "last", "other").unionByName(
        _neighbours(edges).where("last is not null").select("doc", "first", "last", "other"))))
    open_ = durable(_not_reported(found.where("open is not null").select("doc", *EDGE, "open"), known))
    every = _joined(known.unionByName(_held_elsewhere(open_, shared)))
    own = lambda c: F.when(F.col(c) != nobody, F.col(c)).cast(kind)
    return every.select(own("doc").alias("id"), F.col("first").alias("start_word"), F.col("last").alias("end_word"),
                        (F.col("last") - F.col("first")).alias("n_words"), own("other").alias("other"))


def op2_sparse_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_passages(docs).select(
        F.col("id").alias("doc_id"), "start_word", "end_word", "n_words", F.col("other").alias("other_doc_id"))
