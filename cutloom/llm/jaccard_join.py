"""Jaccard join of word n-gram sets by partitioning the token universe (pigeonhole), exact at every size.

Sets are put into size bands that grow by 1 / threshold, so that partners lie in one band or the next. Two sets of a band can
differ in at most H tokens. A band's universe is hashed into segments; a segment is indexed as it is (worth 1) or with all its
one-token deletions (worth 2), and the worths add up to more than H: partners must agree on a segment, or on one up to a token.
Which segments get deletions is chosen per band by the number of keys, as long as segments stay selective. A set may leave out
the SLACK(band) segments that tell least about it (empty ones, then the smallest); twice that many are added to the sum, so the
guarantee holds whatever two sets leave out.

Only one of several equal sets takes part. In a bucket of equal keys each member is first paired with the least one and with the
one before it. Of a set's pairs that with most keys in common is verified first; what such pairs connect needs no pair any more, so a
group of n copies costs about n of them. Then come the other pairs of different components, at last those that no bucket paired. Pairs that parity sketches prove to be too different
are left out, by sketches of one size first, then by some that grow with their sets, as texts are moved to every pair that is left; these
are verified on whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words
from .columns import field, fresh
from .links import components, joined_components
from .slots import bit_table, likely_held, mark

SHINGLE = 4
PERCENT = 85
TOKENS_EXACT, TOKENS_DELETED = 2.5, 4.0  # the least mean size of a segment of either kind
SKETCH_BITS = 512
ROUNDS = 2  # bands are indexed in so many rounds, one after the other, so that only one round's keys lie on disk


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    exact: int  # segments indexed as they are
    deleted: int  # segments with deletions
    slack: int

    @property
    def segments(self) -> int:
        return self.exact + self.deleted


def differ(total: int, percent: int) -> int:
    """The most tokens in which two sets with ``total`` tokens between them differ at ``percent`` similarity."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def bands(largest: int, percent: int) -> tuple[Band, ...]:
    """The bands up to the set size ``largest`` and the one after it."""
    out: list[Band] = []
    low = 1
    while not out or out[-1].low <= largest:
        high = low * 100 // percent
        most = differ(high + high * 100 // percent, percent)
        out.append(Band(len(out), low, high, *_allot(most, low)))
        low = high + 1
    return tuple(out)


def _allot(most: int, low: int) -> tuple[int, int, int]:
    """(exact, deleted, slack): fewest keys among the allotments that keep segments selective, else the most selective.

    The slack is the number of exact segments that a set of ``low`` tokens is expected to leave empty.
    """
    best = None
    for deleted in range((most + 1) // 2 + 2):
        slack = -1
        while True:
            slack += 1
            exact = max(0, most + 1 + 2 * slack - 2 * deleted)
            mean = low / max(1, exact + deleted)
            if exact * math.exp(-mean) <= slack or mean < TOKENS_EXACT:
                break
        good = mean >= (TOKENS_DELETED if deleted else TOKENS_EXACT)
        cost = (not good, exact - slack + deleted * (1 + mean) if good else -mean)
        if exact >= slack and exact + deleted and (best is None or cost < best[0]):
            best = (cost, exact, deleted, slack)
    return best[1:]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, tokens): the sorted distinct 64-bit hashes of each text's word n-grams, one after the other."""
    w = words.Words(texts, words.BY_SPACE)
    h = w.hashes()
    many = np.where(w.counts >= width, w.counts - width + 1, (w.counts > 0).astype(np.int64))
    first = np.cumsum(w.counts) - w.counts
    at = words.ranges(first, many)
    take = np.repeat(np.minimum(w.counts, width), many)
    grams = np.zeros(len(at), np.uint64)
    for k in range(width):
        more = take > k
        grams[more] = words.mix(grams[more] * np.uint64(3) + h[at[more] + k] + np.uint64(k + 1))
    ends = np.cumsum(many)
    for start, end in zip(ends - many, ends):
        grams[start:end].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = grams[1:] != grams[:-1]
    keep[(ends - many)[many > 0]] = True
    return np.bincount(words.row_of(many)[keep], minlength=len(many)), grams[keep]


def per_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums (mod 2^64) of the values of each row."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _parity(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Bit j of a row tells whether an odd number of its tokens hash to j; two sketches differ in no more bits than the sets."""
    bit = (words.mix(tokens ^ np.uint64(0x5BD1E995)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(row * SKETCH_BITS + bit, minlength=rows * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, SKETCH_BITS), axis=1)


def wide_sketches(sizes: np.ndarray, tokens: np.ndarray) -> list[bytes | None]:
    """A parity sketch of each set with as many bits as tokens, rounded up to a power of two; none where the fixed size is enough.

    Two sets without a common token differ in about half of the bits then, whatever their size. A sketch is folded to half its size by XOR.
    """
    large = sizes > SKETCH_BITS
    bits = np.where(large, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    row = words.row_of(sizes)
    mine = large[row]
    row, kept = row[mine], tokens[mine]
    first = np.cumsum(bits) - bits
    bit = (words.mix(kept ^ np.uint64(0x5BD1E995)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(first[row] + bit, minlength=int(bits.sum())) & 1).astype(np.uint8))
    return [packed[a // 8:(a + n) // 8].tobytes() if n else None for a, n in zip(first.tolist(), bits.tolist())]


def _prints(docs: DataFrame, text_col: str, width: int, ids: str) -> DataFrame:
    """(id, text_hash, size, a, b, sketch, wide): size, 128-bit fingerprint and parity sketches of each text's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.shards(batch, text_col):
                sizes, tokens = shingle_sets(texts, width)
                row = words.row_of(sizes)
                a = _node(sizes, tokens)
                b = per_row(words.mix(tokens ^ np.uint64(2)), sizes).view(np.int64)
                sketch = [x.tobytes() for x in _parity(tokens, row, len(sizes))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(a), pa.array(b), pa.array(sketch, pa.binary()),
                     pa.array(wide_sketches(sizes, tokens), pa.binary())], names=["id", "text_hash", "size", "a", "b", "sketch", "wide"])

    kind = docs.schema[ids].dataType.simpleString()
    return docs.select(field(ids), F.xxhash64(field(text_col)), field(text_col)).mapInArrow(
        scan, f"id {kind}, text_hash long, size long, a long, b long, sketch binary, wide binary")


def segment_keys(sizes: np.ndarray, tokens: np.ndarray, percent: int, turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the given sets, as the bands ask for them; of every ``rounds`` bands the one numbered ``turn``."""
    plan = bands(int(sizes.max(initial=1)), percent)
    lows = np.array([b.low for b in plan])
    own = np.searchsorted(lows, sizes, "right") - 1
    out_rows, out_keys = [], []
    for shift in (0, 1):  # the own band, and the one below for smaller partners
        number = own - shift
        rows = np.flatnonzero((sizes > 0) & (number >= 0) & (number % rounds == turn))
        limit = np.array([b.high * 100 // percent for b in plan])
        most = np.array([differ(b.high + b.high * 100 // percent, percent) for b in plan])
        rows = rows[(sizes[rows] <= limit[number[rows]]) & (most[number[rows]] > 0)]
        if not len(rows):
            continue
        band = number[rows]
        start = np.cumsum(sizes)[rows] - sizes[rows]
        t = tokens[words.ranges(start, sizes[rows])]
        r = words.row_of(sizes[rows])
        segments = np.array([b.segments for b in plan])[band]
        exact = np.array([b.exact for b in plan])[band]
        slack = np.array([b.slack for b in plan])[band]
        salt = words.mix(band.astype(np.uint64) + np.uint64(77))
        seg = (words.mix(t ^ salt[r]) % segments[r].astype(np.uint64)).astype(np.int64)
        first = np.cumsum(segments) - segments
        cell, total = first[r] + seg, int(segments.sum())
        value = words.mix(t + np.uint64(11))
        content = np.zeros(total, np.uint64)
        np.add.at(content, cell, value)
        count = np.bincount(cell, minlength=total)
        cell_row = words.row_of(segments)
        place = np.arange(total) - first[cell_row]
        tag = words.mix(salt[cell_row] + place.astype(np.uint64))
        loose = np.flatnonzero(place < exact[cell_row])  # of these, each row leaves out its smallest
        by = loose[np.lexsort((place[loose], count[loose], cell_row[loose]))]
        begin = np.cumsum(exact) - exact
        rank = np.arange(len(by)) - begin[cell_row[by]]
        left = np.zeros(total, bool)
        left[by[rank < slack[cell_row[by]]]] = True
        stay = ~left
        out_rows.append(rows[cell_row[stay]])
        out_keys.append(words.mix(content[stay] + tag[stay]))
        cut = seg >= exact[r]
        out_rows.append(rows[r[cut]])
        out_keys.append(words.mix(content[cell[cut]] - value[cut] + tag[cell[cut]]))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _keys(docs: DataFrame, text_col: str, width: int, percent: int, turn: int) -> DataFrame:
    """(key, node): the segment keys that each distinct set has in the bands of a round, once per task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for _, texts in words.shards(batch, text_col):
                sizes, tokens = shingle_sets(texts, width)
                nodes = _node(sizes, tokens)
                new = np.zeros(len(nodes), bool)
                for k, node in enumerate(nodes.tolist()):
                    if node not in told:
                        told.add(node)
                        new[k] = True
                tokens, sizes, nodes = tokens[np.repeat(new, sizes)], sizes[new], nodes[new]
                row, key = segment_keys(sizes, tokens, percent, turn, ROUNDS)
                for k in range(0, len(row), 1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[k:k + (1 << 16)].view(np.int64)), pa.array(nodes[row[k:k + (1 << 16)]])], names=["key", "node"])

    return docs.select(field(text_col)).mapInArrow(scan, "key long, node long")


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, leader, before, node): each further node of a key with the key's least one and the one before it, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = leader = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            before = np.concatenate([[node[0] if last_node is None else last_node], node[:-1]])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead = np.where(head >= 0, node[head], leader if leader is not None else 0)
            last_key, last_node, leader = key[-1], node[-1], lead[-1]
            more = ~new & (node != before)
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (key, lead, before, node)], names=["key", "leader", "before", "node"])

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        scan, "key long, leader long, before long, node long")


def _near(size_x: np.ndarray, size_y: np.ndarray, sketch_x: np.ndarray, sketch_y: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs that sizes or parity sketches prove to be too different."""
    small, large = np.minimum(size_x, size_y), np.maximum(size_x, size_y)
    bits = np.bitwise_count(sketch_x ^ sketch_y).sum(1)
    return (small * 100 >= large * percent) & (bits <= (small + large) * (100 - percent) // (100 + percent))


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, n) that sizes and sketches do not rule out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            size_x, size_y = rows["size_x"].to_numpy(), rows["size_y"].to_numpy()
            near = _near(size_x, size_y, _sketches(rows["sketch_x"]), _sketches(rows["sketch_y"]), percent)
            yield batch.select(["x", "y", "n"]).filter(pa.array(near))

    x, y = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "xy")
    return pairs.join(x, "x").join(y, "y").select("x", "y", "n", "size_x", "size_y", "sketch_x", "sketch_y").mapInArrow(
        scan, "x long, y long, n long")


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one size as rows of ``size`` bytes."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while rows.shape[1] > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _clear(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that wide sketches do not rule out; small sets have none, their pairs stay."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            wide_x, wide_y = (rows[c].to_pylist() for c in ("wide_x", "wide_y"))
            most = (rows["size_x"].fill_null(0).to_numpy() + rows["size_y"].fill_null(0).to_numpy()) * (100 - percent) // (100 + percent)
            size_x, size_y = (np.array([len(w) if w else 0 for w in side], np.int64) for side in (wide_x, wide_y))
            keep = np.ones(batch.num_rows, bool)
            for a, b in set(zip(size_x.tolist(), size_y.tolist())):
                if a and b:
                    at, least = np.flatnonzero((size_x == a) & (size_y == b)), min(a, b)
                    differ_in = np.bitwise_count(_folded([wide_x[k] for k in at], least) ^ _folded([wide_y[k] for k in at], least)).sum(1)
                    keep[at] = differ_in <= most[at]
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    x, y = (nodes.where("wide is not null").select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "xy")
    return pairs.select("x", "y").join(x, "x", "left").join(y, "y", "left").select("x", "y", "size_x", "size_y", "wide_x", "wide_y").mapInArrow(
        scan, "x long, y long")


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (x, y) that lie in different components."""
    for c in "xy":
        pairs = pairs.join(linked.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return pairs.where("coalesce(rx, x) <> coalesce(ry, y)").select("x", "y")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of a key whose components differ and whose sketches do not rule them out."""

    def pairs(comp: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(node), 256):
            one = slice(start, start + 256)
            for other in range(start, len(node), 4096):
                two = slice(other, other + 4096)
                ok = comp[one, None] != comp[None, two]
                ok &= np.arange(start, start + ok.shape[0])[:, None] < np.arange(other, other + ok.shape[1])[None]
                i, j = np.nonzero(ok)
                i, j = i + start, j + other
                near = _near(size[i], size[j], sketch[i], sketch[j], percent)
                yield _pairs(node[i[near]], node[j[near]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held["key"].to_numpy()
            if len(key) and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield from groups(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from groups(held)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, comp, node, size = (table[c].to_numpy() for c in ("key", "comp", "node", "size"))
        sketch = _sketches(table["sketch"])
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        for a, b in zip(starts, [*starts[1:], len(key)]):
            yield from pairs(comp[a:b], node[a:b], size[a:b], sketch[a:b])

    return members.repartition("key").sortWithinPartitions("key", "comp", "node").select(
        "key", "comp", "node", "size", "sketch").mapInArrow(scan, "x long, y long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, ids: str, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are similar, told by the whole texts of one document each."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in words.shards(batch, "tx"):
                right = words.text_array(part.column(part.schema.get_field_index("ty")))
                (n, s), (m, t) = shingle_sets(left, width), shingle_sets(right, width)
                x, y = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                # only the text that the node stands for counts
                good = (_node(n, s) == x) & (_node(m, t) == y)
                for k, (a, b) in enumerate(zip(np.cumsum(n), np.cumsum(m))):
                    both = len(np.intersect1d(s[a - n[k]:a], t[b - m[k]:b], assume_unique=True))
                    good[k] &= 100 * both >= percent * (n[k] + m[k] - both)
                yield part.select(["x", "y"]).filter(pa.array(good))

    pairs = durable(_clear(pairs, nodes, percent))
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    chosen = durable(nodes.select("node", "doc", "text_hash").join(wanted, "node", "left_semi"))
    own = docs.select(field(ids).alias("doc"), F.xxhash64(field(text_col)).alias("text_hash"), field(text_col).alias("text"))
    own = likely_held(own, chosen, ["doc", "text_hash"])
    nameless = own.where("doc is null").dropDuplicates(["text_hash"])  # a set that only rows without an id hold
    met = own.where("doc is not null").join(chosen, ["doc", "text_hash"]).unionByName(
        nameless.drop("doc").join(chosen.where("doc is null"), "text_hash"))
    texts = durable(met.select("node", "text"))
    x, y = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "xy")
    return durable(pairs.join(x, "x").join(y, "y").select("x", "y", "tx", "ty").mapInArrow(test, "x long, y long"))


def _node(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The node of each set: half of its fingerprint."""
    return per_row(words.mix(tokens ^ np.uint64(1)), sizes).view(np.int64)


def _split_members(buckets: DataFrame, pairs: DataFrame, linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, comp, size, sketch) of the keys whose members are not all in one component.

    ``pairs`` holds each leader and node that share a bucket once, so components are looked up for these and not for every bucket; the
    buckets themselves are told apart by tables of keys and not shuffled.
    """
    apart = durable(_apart(pairs.select("x", "y"), linked))
    some = likely_held(buckets.select("key", F.col("leader").alias("x"), F.col("node").alias("y")), apart, ["x", "y"])
    split = durable(some.join(apart, ["x", "y"], "left_semi").select("key").distinct())
    rows = durable(likely_held(buckets, split, ["key"]).join(split, "key", "left_semi"))
    members = rows.select("key", "node").unionByName(rows.select("key", F.col("leader").alias("node"))).distinct()
    return members.join(linked, "node", "left").withColumn("comp", F.coalesce("root", "node")).join(
        nodes.select("node", "size", "sketch"), "node")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of each row: texts link when 100 * |A and B| >= percent * |A or B| for their shingle sets.

    Words are runs without ASCII white space, A-Z lower-cased; a shingle is ``width`` words, or all words of a shorter text.
    component_id is the least id that links lead to, the own one included; null and empty texts have no shingles and keep their
    own id. Rows that repeat an id, and rows with null ids, take part like others; a class of null ids only has a null class. Two sets
    with one 64-bit node (half of a 128-bit fingerprint) would count as one.
    Other columns play no part. An empty table gives no rows.
    """
    narrow = docs.select(field(id_col).alias("id"), field(text_col).alias("text"))
    prints = durable(_prints(narrow, "text", width, "id"))
    stands = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_hash", "size", "sketch", "wide")).alias("s")  # one row for each set
    nodes = durable(prints.where("size > 0").groupBy(F.col("a").alias("node")).agg(stands).select(
        "node", F.col("s.id").alias("doc"), "s.text_hash", "s.size", "s.sketch", "s.wide"))
    # a key belongs to one band, so no bucket spans two rounds
    buckets = reduce(DataFrame.unionByName, [durable(_buckets(_keys(narrow, "text", width, percent, turn))) for turn in range(ROUNDS)])
    ordered = [F.struct(F.least(o, "node").alias("x"), F.greatest(o, "node").alias("y")) for o in ("leader", "before")]
    counted = durable(buckets.select(F.explode(F.array_distinct(F.array(*ordered))).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n")))
    first = durable(_possible(counted, nodes, percent))
    # the partner with most keys in common first: what these pairs connect needs no other pair, and no text a second time
    best = first.groupBy("y").agg(F.max(F.struct("n", "x")).alias("b")).select(F.col("b.x").alias("x"), "y")
    linked = durable(components(_verified(best, nodes, narrow, "text", "id", width, percent)))
    apart = durable(_apart(first.select("x", "y").join(best, ["x", "y"], "left_anti"), linked))
    if not apart.isEmpty():
        linked = durable(joined_components(linked, _verified(apart, nodes, narrow, "text", "id", width, percent)))
    members = _split_members(buckets, counted, linked, nodes)
    rest = durable(_across(members, percent).distinct().join(first.select("x", "y"), ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        more = _verified(rest, nodes, narrow, "text", "id", width, percent)
        linked = joined_components(linked, more)
    roots = durable(nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "doc"))
    least = roots.groupBy("root").agg(F.min("doc").alias("component"))
    of_node = roots.join(least, "root").select(F.col("node").alias("a"), "component")
    return prints.join(of_node, "a", "left").select(
        "id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class (null ids stay), with the columns of ``docs``. Ids are unique."""
    (gone,) = fresh(docs, "gone")
    drop = durable(similar_classes(docs, id_col, text_col, **options).where("component_id <> id").select(F.col("id").alias(id_col)))
    told = mark(docs, bit_table(drop, [id_col]), [id_col], gone)
    sure = told.where(~field(gone)).drop(gone)
    return sure.unionByName(told.where(field(gone)).drop(gone).join(drop, id_col, "left_anti").select(*map(field, docs.columns)))


def op7_universe_partition(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_classes(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
