"""Fill-in-middle transformation by displacement scatter: texts are cut into lines, and their three parts change places.

Everything happens on the bytes of a whole Arrow batch. A scan finds where each text is cut; a difference array holds, at the
start of each part, by how much its displacement differs from that of the part before; the running sum of it is every byte's
displacement, and one numpy scatter puts all bytes into the output. ``restored`` finds the marks in the output, builds the same
displacements from them alone and gathers the bytes back. Both work in blocks, so that a very long text needs little more
memory than its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import field, fresh, whole, with_fields
from .words import bytes_of, shards, text_array

BLOCK = 1 << 20  # bytes whose displacements are held at once
RESULTS = ("n_lines", "form", "prefix_chars", "middle_chars", "output")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Marks:
    """What stands before each part. No mark may overlap another one or itself, so that a mark in the output is one that was put there."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in self.all:
            for b in self.all:
                if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"marks overlap: {a!r} {b!r}")
        if len(set(self.all)) < 3 or not all(self.all):
            raise ValueError("marks must differ and have a character")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def line_ends(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte places behind each line, the last line of a text included; ascending, none twice."""
    ends = np.flatnonzero(raw == 10) + 1
    return np.union1d(ends, off[1:][np.diff(off) > 0])


def count_at(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many code points start before each of the ascending byte places."""
    out = np.zeros(len(places), np.int64)
    done = lo = 0
    for start in range(0, len(raw) + 1, BLOCK):
        stop = min(start + BLOCK, len(raw))
        hi = len(places) if stop == len(raw) else int(np.searchsorted(places, stop))
        seen = np.zeros(stop - start + 1, np.int64)
        np.cumsum((raw[start:stop] & 0xC0) != 0x80, out=seen[1:])
        out[lo:hi] = done + seen[places[lo:hi] - start]
        done, lo = done + seen[-1], hi
    return out


def displaced(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Block by block, where each of ``size`` bytes lies on the other side: part k starts at starts[k] and moves by shifts[k].

    Parts follow each other; empty ones, which share their start with the next, do no harm.
    """
    steps = np.diff(shifts, prepend=0)
    carry, lo = 0, 0
    for start in range(0, size, BLOCK):
        stop = min(start + BLOCK, size)
        hi = int(np.searchsorted(starts, stop))
        steps_here = np.zeros(stop - start, np.int64)
        np.add.at(steps_here, starts[lo:hi] - start, steps[lo:hi])
        moved = np.cumsum(steps_here)
        moved += carry
        carry, lo = moved[-1], hi
        moved += np.arange(start, stop)
        yield slice(start, stop), moved


def _as_texts(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw)])


def _layout(form: np.ndarray, sizes: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output offsets, place of each part (n, 3), place of each mark (n, 3)); parts and marks in the order prefix, middle, suffix.

    ``sizes`` (n, 3) are the bytes of the parts; form 0 is plain (all bytes are prefix), 1 psm, 2 spm.
    """
    p, s, m = (len(x.encode()) for x in marks.all)
    cut = form > 0
    off = np.zeros(len(form) + 1, np.int64)
    np.cumsum(sizes.sum(1) + cut * (p + s + m), out=off[1:])
    part, mark = np.empty_like(sizes), np.empty_like(sizes)
    spm = form == 2
    base = off[:-1]
    mark[:, 0] = base + spm * (s + sizes[:, 2])
    part[:, 0] = mark[:, 0] + cut * p
    mark[:, 2] = base + ~spm * (p + sizes[:, 0])
    part[:, 2] = mark[:, 2] + s
    mark[:, 1] = base + p + s + sizes[:, 0] + sizes[:, 2]
    part[:, 1] = mark[:, 1] + m
    return off, part, mark


def transform(texts: pa.Array, draws: np.ndarray, rate: int, spm_rate: int, marks: Marks) -> dict[str, pa.Array]:
    """The result columns of ``texts``; ``draws`` (n, 4) are each row's four unsigned numbers."""
    raw, off = bytes_of(texts)
    ends = line_ends(raw, off)
    low = np.searchsorted(ends, off[:-1], "right")
    n = np.searchsorted(ends, off[1:], "right") - low
    held = np.zeros(len(n), bool)
    for mark in marks.all:
        held |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (np.diff(off) == 0) | held | (draws[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < spm_rate, 2, 1))

    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    places = np.empty((len(n), 4), np.int64)
    places[:, 0], places[:, 3] = off[:-1], off[1:]
    for k in (0, 1):
        behind = ends[np.maximum(low + cuts[:, k] - 1, 0)] if len(ends) else off[:-1]
        places[:, k + 1] = np.where(plain, off[1:], np.where(cuts[:, k] == 0, off[:-1], behind))
    out_off, part, mark = _layout(form, np.diff(places, axis=1), marks)

    out = np.empty(out_off[-1], np.uint8)
    starts = places[:, :3].ravel()
    for here, there in displaced(len(raw), starts, part.ravel() - starts):
        out[there] = raw[here]
    for k, text in zip((0, 2, 1), marks.all):
        for j, byte in enumerate(text.encode()):
            out[mark[form > 0, k] + j] = byte

    chars = np.diff(count_at(raw, places.ravel()).reshape(-1, 4), axis=1)
    return {"n_lines": pa.array(n, pa.int64()), "form": pa.array(np.array([PLAIN, PSM, SPM], object)[form], pa.string()),
            "prefix_chars": pa.array(chars[:, 0], pa.int64(), mask=plain), "middle_chars": pa.array(chars[:, 1], pa.int64(), mask=plain),
            "output": _as_texts(out, out_off)}


def _first(raw: np.ndarray, off: np.ndarray, text: str) -> np.ndarray:
    """The first place of ``text`` at or behind the start of each row (the end of all rows where there is none)."""
    want = np.frombuffer(text.encode(), np.uint8)
    found = []
    for start in range(0, max(len(raw) - len(want) + 1, 0), BLOCK):
        stop = min(start + BLOCK, len(raw) - len(want) + 1)
        same = raw[start:stop] == want[0]
        for j in range(1, len(want)):
            same &= raw[start + j:stop + j] == want[j]
        found.append(np.flatnonzero(same) + start)
    places = np.append(np.concatenate(found) if found else np.zeros(0, np.int64), len(raw))
    return places[np.searchsorted(places, off[:-1])]


def gathered(outputs: pa.Array, forms: np.ndarray, marks: Marks) -> pa.Array:
    """The texts that ``outputs`` were made of; only the outputs and their forms are looked at."""
    raw, off = bytes_of(outputs)
    form = np.select([forms == PSM, forms == SPM], [1, 2], 0)
    cut = form > 0
    p, s, m = (_first(raw, off, x) for x in marks.all)
    wp, ws, wm = (len(x.encode()) for x in marks.all)
    sizes = np.zeros((len(form), 3), np.int64)
    sizes[:, 0] = np.where(cut, np.where(form == 2, m, s) - p - wp, np.diff(off))
    sizes[:, 1] = np.where(cut, off[1:] - m - wm, 0)
    sizes[:, 2] = np.where(cut, np.where(form == 2, p, m) - s - ws, 0)
    if (sizes < 0).any() or (cut & (np.maximum(np.maximum(p, s), m) >= off[1:])).any():
        raise ValueError("an output lacks the marks of its form")
    _, part, _ = _layout(form, sizes, marks)
    back = np.zeros(len(form) + 1, np.int64)
    np.cumsum(sizes.sum(1), out=back[1:])
    starts = (back[:-1, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
    text = np.empty(back[-1], np.uint8)
    for here, there in displaced(len(text), starts, part.ravel() - starts):
        text[here] = raw[there]
    return _as_texts(text, back)


def draws_of(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight hex digits of the SHA-256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
                   spm_rate: int = 50, marks: Marks = Marks(), carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all if left out) with n_lines, form, prefix_chars, middle_chars and output.

    Cuts lie between lines and hang on the seed and the id alone. ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these are
    written suffix first. Texts that are empty (null counts as empty) or hold a mark stay plain: output is the text, and both
    lengths are null. Rows that repeat an id are cut alike where their texts are alike; a null id draws as an empty one. Columns
    of ``docs`` named like a result are replaced, all others pass through. An empty table gives no rows.
    """
    names = fresh(docs, "text", "h1", "h2", "h3", "h4")
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    asked = docs.select(*map(field, keep), *(c.alias(n) for c, n in zip([whole(field(text_col)), *draws_of(field(id_col), seed)], names)))
    schema = with_fields(docs, keep, "n_lines long, form string, prefix_chars long, middle_chars long, output string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in shards(batch, names[0]):
                draws = np.stack([rows.column(rows.schema.get_field_index(h)).to_numpy(zero_copy_only=False) for h in names[1:]], axis=1)
                made = transform(texts, draws, rate, spm_rate, marks)
                made["output"] = made["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], *made.values()], names=[*keep, *made])

    return asked.mapInArrow(work, schema)


def restored(made: DataFrame, out: str = "restored", marks: Marks = Marks()) -> DataFrame:
    """``made`` (with the columns form and output) with the column ``out``: the text each output was made of.

    Rows whose output is null give an empty text. An output without the marks of its form is an error.
    """
    made = made.drop(out)
    schema = with_fields(made, made.columns, f"`{out}` string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, outputs in shards(batch, "output"):
                forms = np.array(rows.column(rows.schema.get_field_index("form")).to_pylist(), object)
                text = gathered(text_array(outputs), forms, marks).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, text], names=[*rows.schema.names, out])

    return made.mapInArrow(work, schema)


def op11_displacement_scatter(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs, carry=["doc_id"])
    return restored(made).select("doc_id", F.col("n_lines").alias("n"), "form", "prefix_chars", "middle_chars",
                                 F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
                  sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select *, len(u) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3,
             ('0x' || h[25:32])::ubigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                        else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(text) as restored_sha256 from p
"""
