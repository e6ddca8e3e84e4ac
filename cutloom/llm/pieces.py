"""SentencePiece encoding by merges with seeded merge-dropout, and its lossless decoding.

A word (a run of spaces and what follows it) is encoded by an agenda of candidate merges, best rank first, then leftmost. A
candidate is skipped if the keyed hash of (seed, document id, the word's place in the text, word, place, left piece, right piece)
falls below the dropout rate, so a seed always gives the same segmentation and another seed another one, and each occurrence of a
word is cut by itself. All distinct words of a shard go through the plain agenda once, side by side in numpy; occurrences that
skip one of the candidates met there go through their own agenda. Very long words have a heap of their own, with the same result.
With a rate of 0 this is the plain encoding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .columns import field, fresh, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 1
LONG = 48  # symbols; longer words use the heap
SPACE = "▁"
SHIFT = np.uint64(22)
NONE = np.int32((1 << 31) - 1)
CELLS = 1 << 19  # symbols encoded side by side
SHARD = 4 << 20  # bytes of text whose distinct words are encoded together


@dataclass
class Vocabulary:
    """Pieces with their ranks (0 is merged first); ``byte`` is the id of the piece of byte 0."""

    pieces: list[str]
    ranks: list[int]
    byte: int

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys of pairs, rank, merged piece) of every way to put a piece together from two symbols."""
        known = {p: k for k, p in enumerate(self.pieces) if self.ranks[k] >= 0}
        symbol = lambda p: known.get(p, len(self.pieces) + ord(p) if len(p) == 1 else -1)
        rows = sorted((symbol(p[:i]) << int(SHIFT) | symbol(p[i:]), self.ranks[k], k) for p, k in known.items()
                      for i in range(1, len(p)) if symbol(p[:i]) >= 0 and symbol(p[i:]) >= 0)
        table = np.array(rows, np.int64).reshape(-1, 3)
        return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

    @cached_property
    def symbols(self) -> np.ndarray:
        """The first symbol of each code point: its piece, or beyond the pieces one that has none."""
        out = np.arange(0x110000, dtype=np.int64) + len(self.pieces)
        for k, p in enumerate(self.pieces):
            if len(p) == 1 and self.ranks[k] >= 0:
                out[ord(p)] = k
        out[ord(" ")] = out[ord(SPACE)]
        out[ord(SPACE)] = len(self.pieces) + ord(SPACE)  # a real U+2581 goes by its bytes, or it would come back as a space
        return out

    @cached_property
    def raw(self) -> pa.Array:
        """The bytes that each piece decodes to."""
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        out[self.byte:self.byte + 256] = [bytes([b]) for b in range(256)]
        return pa.array(out, pa.large_binary())


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read on the driver; tasks get the pieces, not the path. Pieces are ranked by score, equal scores alike."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    order = {s: k for k, s in enumerate(sorted({model.get_score(k) for k in plain}, reverse=True))}
    ranks = [-1] * size
    for k in plain:
        ranks[k] = order[model.get_score(k)]
    return Vocabulary([model.id_to_piece(k) for k in range(size)], ranks, model.piece_to_id("<0x00>"))


@dataclass
class Dropout:
    rate: float
    seed: int

    def skips(self, word: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each candidate is skipped; ``word`` are hashes of the word and its occurrence."""
        if not self.rate:
            return np.zeros(len(word), bool)
        h = words.mix(word + words.mix(place.astype(np.uint64) + np.uint64(self.seed * 0x9E3779B9 & (1 << 63) - 1)))
        h = words.mix(h ^ (left.astype(np.uint64) << SHIFT | right.astype(np.uint64)))
        return (h >> np.uint64(11)).astype(np.float64) < self.rate * (1 << 53)


class Candidates:
    """Stands in for Dropout: skips nothing and notes the candidates of each word."""

    rate = 0.0

    def __init__(self):
        self.met: list[tuple[np.ndarray, ...]] = []

    def skips(self, word: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        self.met.append((word.astype(np.int64), *(x.astype(np.int32) for x in (place, left, right))))
        return np.zeros(len(word), bool)

    def by_word(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(offsets, [place, left, right]) of the candidates of words 0 to n - 1."""
        word, *rest = (np.concatenate(x) for x in zip(*self.met)) if self.met else [np.zeros(0, np.int64)] * 4
        by = np.argsort(word, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))]), [x[by] for x in rest]


def _look_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, ranks, merged = v.merges
    key = left.astype(np.int64) << np.int64(SHIFT) | right
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    return np.where(hit, ranks[at], NONE).astype(np.int32), np.where(hit, merged[at], -1).astype(np.int32)


def _side_by_side(v: Vocabulary, symbols: np.ndarray, word: np.ndarray, drop: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths) after all merges; ``symbols`` has one word per row, -1 behind its end.

    Each turn merges the best candidate of every word that has one and takes the right symbol's column out of its row.
    """
    n, width = symbols.shape
    ids, key, alive = symbols.astype(np.int32), word, np.arange(n)
    at = np.tile(np.arange(width, dtype=np.int32), (n, 1))
    size = (ids >= 0).sum(1)

    def ranked(rows: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = ids[rows, col], ids[rows, col + 1]
        rank, made_ = _look_up(v, left, right)
        ok = np.flatnonzero(rank < NONE)
        gone = drop.skips(key[rows[ok]], at[rows[ok], col[ok]], left[ok], right[ok])
        rank[ok[gone]] = NONE
        return rank, made_

    done, length = ids.copy(), size.copy()
    best, made = np.full((n, width), NONE), np.full((n, width), -1, np.int32)
    if width > 1:
        rows, cols = np.nonzero(ids[:, 1:] >= 0)
        best[rows, cols], made[rows, cols] = ranked(rows, cols)
    while len(alive):
        j = best.argmin(1)
        row = np.arange(len(alive))
        go = best[row, j] < NONE
        if not go.all():
            over = alive[~go]
            done[over, :ids.shape[1]], length[over] = ids[~go], size[~go]
            ids, at, key, alive, best, made, size, j = (x[go] for x in (ids, at, key, alive, best, made, size, j))
            row = np.arange(len(alive))
            if not len(alive):
                break
        ids[row, j] = made[row, j]
        stay = np.ones(ids.shape, bool)
        stay[row, j + 1] = False
        ids, at, best, made = (x[stay].reshape(len(alive), -1) for x in (ids, at, best, made))
        size = size - 1
        best[row, j] = NONE
        more = row[j + 1 < size]
        best[more, j[more]], made[more, j[more]] = ranked(more, j[more])
        less = row[j > 0]
        best[less, j[less] - 1], made[less, j[less] - 1] = ranked(less, j[less] - 1)
    return done, length


def _by_heap(v: Vocabulary, symbols: np.ndarray, word: np.uint64, drop: Dropout) -> list[int]:
    """The same for one word of any length: a heap of candidates, stale ones dropped when they come up."""
    ids, n = symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def add(place: np.ndarray) -> None:
        place = np.asarray(place, np.int64)
        left = np.array([ids[p] for p in place], np.int64)
        right = np.array([ids[after[p]] for p in place], np.int64)
        rank, made = _look_up(v, left, right)
        ok = (rank < NONE) & ~drop.skips(np.full(len(place), word, np.uint64), place, left, right)
        for x in zip(*(a[ok].tolist() for a in (rank, place, left, right, made))):
            heapq.heappush(heap, x)

    add(np.arange(n - 1))
    while heap:
        _, p, left, right, made = heapq.heappop(heap)
        q = after[p] if ids[p] == left else n
        if q >= n or ids[q] != right:
            continue
        ids[p], ids[q] = made, -1
        after[p] = after[q]
        if after[p] < n:
            before[after[p]] = p
        add([x for x in (before[p], p) if x >= 0 and after[x] < n])
    return [x for x in ids if x >= 0]


def _encode_words(v: Vocabulary, vocabulary: list[str], code: np.ndarray, key: np.ndarray, drop: Dropout | Candidates):
    """(ids, offsets) of the words ``vocabulary[code]``, whose occurrences have the given keys."""
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    flat = np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in vocabulary], np.int64)
    first = np.cumsum(size) - size
    symbols = v.symbols[flat]
    length = size[code]
    order = np.argsort(length, kind="stable")
    sizes = length[order]
    spots, values = [], []
    start = 0
    while start < len(order):
        if sizes[start] > LONG:
            k = order[start]
            got = np.array(_by_heap(v, symbols[first[code[k]]:first[code[k]] + length[k]], key[k], drop), np.int64)
            spots.append(np.full(len(got), k))
            values.append(got)
            start += 1
            continue
        stop = start + 1 + max(1, CELLS // max(1, int(sizes[start])))
        stop = min(stop, int(np.searchsorted(sizes, min(LONG, int(sizes[start]) + 2), "right")))
        block = order[start:stop]
        width = int(length[block[-1]])
        cells = first[code[block]][:, None] + np.arange(width)
        inside = np.arange(width) < length[block][:, None]
        matrix = np.where(inside, symbols[np.minimum(cells, len(symbols) - 1)], -1)
        got, many = _side_by_side(v, matrix, key[block], drop)
        keep = np.arange(width) < many[:, None]
        spots.append(np.repeat(block, many))
        values.append(got[keep])
        start = stop
    spot, value = np.concatenate(spots), np.concatenate(values)
    by = np.argsort(spot, kind="stable")
    spot, value = spot[by], value[by]
    loose = value >= len(v.pieces)  # symbols without a piece go by their UTF-8 bytes
    if loose.any():
        points = value[loose] - len(v.pieces)
        raw = [chr(p).encode() for p in points.tolist()]
        many = np.ones(len(value), np.int64)
        many[loose] = [len(b) for b in raw]
        spread = np.repeat(value, many)
        spread[np.repeat(loose, many)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + v.byte
        spot, value = np.repeat(spot, many), spread
    return value.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(spot, minlength=len(code)))])


def _skipping(offsets: np.ndarray, candidates: list[np.ndarray], code: np.ndarray, key: np.ndarray, drop: Dropout) -> np.ndarray:
    """The occurrences that skip a candidate which the plain agenda of their word met; all others are cut as without dropout."""
    many = np.diff(offsets)[code]
    ends = np.cumsum(many)
    out, start = [], 0
    while start < len(code):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
        n = many[start:stop]
        entry = words.ranges(offsets[code[start:stop]], n)
        gone = drop.skips(np.repeat(key[start:stop], n), *(x[entry] for x in candidates))
        out.append(np.unique(words.row_of(n)[gone]) + start)
        start = stop
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_texts(v: Vocabulary, texts: pa.Array, document: np.ndarray, drop: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts. A space is put before a text that is not empty, as the model asks for.

    ``document`` has a number of each text's document, which keys its skips.
    """
    raw, off = words.bytes_of(texts)
    size = np.diff(off)
    many = size + (size > 0)
    begin = np.cumsum(many) - many
    data, own = np.full(int(many.sum()), 32, np.uint8), np.ones(int(many.sum()), bool)
    own[begin[size > 0]] = False
    data[own] = raw
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = data == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[begin[size > 0]] = True
    starts = np.flatnonzero(starts)
    every = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    coded = every.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.searchsorted(begin[size > 0], starts, "right") - 1
    row = np.flatnonzero(size > 0)[row]
    vocabulary = coded.dictionary.to_pylist()
    met = Candidates()
    every_word = np.arange(len(vocabulary))
    ids, offsets = _encode_words(v, vocabulary, every_word, every_word.astype(np.uint64), met)
    begins, length = offsets[code], np.diff(offsets)[code]
    if drop.rate:
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        base = words.mix(pd.util.hash_array(np.array(vocabulary, dtype=object), categorize=False))
        key = words.mix(base[code] + words.mix(words.mix(document.astype(np.int64).view(np.uint64))[row] + nth.astype(np.uint64)))
        again = _skipping(*met.by_word(len(vocabulary)), code, key, drop)
        more, offsets = _encode_words(v, vocabulary, code[again], key[again], drop)
        begins[again], length[again] = len(ids) + offsets[:-1], np.diff(offsets)
        ids = np.concatenate([ids, more])
    out = ids[words.ranges(begins, length)]
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, weights=length, minlength=len(texts)).astype(np.int64))])


def decode_ids(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of id lists; the space before each is taken off again."""
    taken = v.raw.take(pa.array(ids))
    raw, off = words.bytes_of(taken)
    ends = off[offsets]
    keep = np.ones(len(raw), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    ends = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[keep])])


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE,
                  seed: int = SEED, carry: list[str] | None = None, out: str = "pieces", check: str | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) with ``out``, the piece ids of the whole text.

    ``rate`` of the candidate merges are skipped by keyed hash; the key has the id and the word's place in the text, so each
    occurrence of a word may be cut differently, and always alike under one seed. Rows with a null id have one key. ``check`` names a column that tells whether decoding the ids
    gave the text back. Null and empty texts have no pieces. Repeated rows get equal pieces; columns named like a result are
    replaced; an empty table gives no rows.
    """
    made = [out, *([check] if check else [])]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {m.lower() for m in made}]
    (document,) = fresh(docs, "document")
    drop = Dropout(rate, seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(document)
            for part, texts in words.shards(batch, text_col, SHARD):
                ids, offsets = encode_texts(vocabulary, texts, part.column(at).to_numpy(zero_copy_only=False), drop)
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                kept.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)))
                if check:
                    kept.append(pc.equal(decode_ids(vocabulary, ids, offsets), texts))
                yield pa.RecordBatch.from_arrays(kept, names=[*carry, *made])

    named = docs.withColumn(document, F.xxhash64(F.lit(seed), field(id_col)))
    return named.select(*map(field, dict.fromkeys([*carry, text_col, document]))).mapInArrow(
        scan, with_fields(docs, carry, f"`{out}` array<int>" + (f", `{check}` boolean" if check else "")))


def decode_pieces(coded: DataFrame, vocabulary: Vocabulary, pieces_col: str = "pieces", carry: list[str] | None = None,
                  out: str = "decoded") -> DataFrame:
    """``carry`` columns (all by default) with ``out``, the text of the piece ids; no ids or null give an empty text."""
    carry = [c for c in (coded.columns if carry is None else carry) if c.lower() != out.lower()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pieces_col))
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            texts = decode_ids(vocabulary, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, texts.cast(pa.string())], names=[*carry, out])

    return coded.select(*map(field, dict.fromkeys([*carry, pieces_col]))).mapInArrow(scan, with_fields(coded, carry, f"`{out}` string"))


def encode_and_check(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE,
                     seed: int = SEED) -> DataFrame:
    """(id, n_pieces, pieces, lossless): the encoding, and whether decoding it gives the whole text back."""
    coded = encode_pieces(docs, vocabulary, id_col, text_col, rate, seed, [id_col], "pieces", "lossless")
    return coded.select(field(id_col), F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")


def op9_merge_dropout(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_check(docs, load_vocabulary())
