"""Words of whole Arrow columns as numpy arrays; helpers of the operators that work on word sequences inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = b" \t\n\x0b\f\r"
BY_SPACE = np.ones(256, bool)
BY_SPACE[list(SPACE_BYTES)] = False
ALNUM = np.ones(256, bool)
ALNUM[:128] = False
ALNUM[ord("0"):ord("9") + 1] = ALNUM[ord("A"):ord("Z") + 1] = ALNUM[ord("a"):ord("z") + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

SHARD_BYTES = 3 << 20
FIELD = pa.large_string()


def text_array(column: pa.Array) -> pa.Array:
    """A contiguous large_string array with nulls as empty texts."""
    column = column.cast(FIELD).fill_null("")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column.slice(0, 0), column])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text array, offsets starting at 0."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def shards(batch: pa.RecordBatch, text_col: str, limit: int = SHARD_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of ``batch`` of about ``limit`` bytes of text, one row at least, with their texts."""
    column = batch.column(batch.schema.get_field_index(text_col))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start), text_array(column.slice(start, stop - start))
        start = stop


class Words:
    """The words of a text array: ``codes`` index ``vocabulary``; ``counts`` has the words of each text.

    ``starts`` and ``ends`` are byte positions in the concatenated texts.
    """

    def __init__(self, texts: pa.Array, classes: np.ndarray, lower: bool = True):
        raw, off = bytes_of(texts)
        inside = classes[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True  # a word never spans two texts
        before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
        if len(raw):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.counts = np.diff(np.searchsorted(self.starts, off))
        data = (LOWER[raw] if lower else raw)[inside]
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        every = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = every.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same everywhere."""
        if not len(self.codes):
            return np.zeros(0, np.uint64)
        return hash_values(self.vocabulary)[self.codes]


def hash_values(values: pa.Array) -> np.ndarray:
    objects = np.array(values.cast(pa.large_string()).to_pylist() or [""], dtype=object)
    return mix(pd.util.hash_array(objects, categorize=False))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (a bijection)."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_of(counts: np.ndarray) -> np.ndarray:
    """The row of each element of rows that have ``counts`` elements."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(counts.sum())
