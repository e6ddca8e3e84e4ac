"""Byte-range planning: merging, holders, pages, concatenated layouts, size projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .fold import chain_marks, grouped
from .intervals import explode_range, overlap_join
from .scan import islands, span_of, span_scan


def _islands(ranges: DataFrame, gap: int, width: float) -> DataFrame:
    x = ranges.where("len > 0").withColumn("__end", F.col("off") + F.col("len"))
    return islands(x, ["source_id"], "off", "__end", gap, ["idx"], span_of("off", width))


def merge_ranges(ranges: DataFrame, gap: int = 0, width: float = 1 << 24) -> DataFrame:
    """Merge ranges (source_id, idx, off, len) whose distance is at most ``gap``; empty ranges are dropped."""
    return _islands(ranges, gap, width).groupBy("source_id", "island").agg(
        F.min("off").alias("m_off"), (F.max("__end") - F.min("off")).alias("m_len"), F.count("*").alias("members"))


def assign_holders(ranges: DataFrame, gap: int = 0, width: float = 1 << 24) -> DataFrame:
    """Every requested range with the merged range that holds it and its offset inside."""
    x = _islands(ranges, gap, width)
    m = x.groupBy("source_id", "island").agg(F.min("off").alias("m_off"), (F.max("__end") - F.min("off")).alias("m_len"))
    return x.join(m, ["source_id", "island"]).withColumn("local_offset", F.col("off") - F.col("m_off")).drop("__end", "island")


def merge_ranges_bounded(ranges: DataFrame, gap: int, max_length: int, width: float = 1 << 24) -> DataFrame:
    """``merge_ranges`` with a length limit, greedy in offset order.

    Each range learns which one would start the next group if it started one itself: that hangs only on ranges that start within the limit
    behind it, so spans of ``width`` with that much of the next ones are enough. The groups are the chain of these pointers inside each island;
    an island is cut into spans too and is no single task. One range always fits, however long. Islands that fit as a whole are one group.
    """
    x = _islands(ranges, gap, width)
    island = ["source_id", "island"]
    told = durable(x.groupBy(*island).agg(
        F.min("off").alias("m_off"), (F.max("__end") - F.min("off")).alias("m_len"), F.count("*").alias("members")))
    fits = (F.col("m_len") <= max_length) | (F.col("members") == 1)
    whole = told.where(fits).withColumn("part", F.lit(1).cast("bigint"))
    x = x.join(told.where(~fits).select(*island), island, "left_semi")
    x = durable(span_scan(x, ["source_id", "island"], ["off", "idx"], span_of("off", width), at=("row_number",)).select(
        "source_id", "island", "off", "idx", "__end", "at"))
    block = F.floor(F.col("off") / F.lit(float(width))).cast("bigint")
    first = F.floor((F.col("off") - max_length) / F.lit(float(width))).cast("bigint")
    seen = x.withColumn("__own", block).withColumn("__block", F.explode(F.sequence(F.least(first, block), block)))

    def follow(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        off, end, at = (pdf[c].tolist() for c in ("off", "__end", "at"))
        own = (pdf["__own"] == pdf["__block"]).to_numpy()
        succ = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for i in range(lo, lo + int(own[lo:hi].sum())):  # own rows come first
                reach, j = end[i], i + 1
                while j < hi and off[j] <= reach + gap and max(reach, end[j]) - off[i] <= max_length:
                    reach, j = max(reach, end[j]), j + 1
                succ.append(at[i] + j - i)  # maybe one behind the last of the island
        out = pdf.loc[own, ["source_id", "island", "at"]].copy()
        out["succ"] = succ
        return out

    kind = dict(x.dtypes)
    follows = grouped(seen, ["source_id", "island", "__block"], ["at"], follow, f"source_id {kind['source_id']}, island {kind['island']}, at bigint, succ bigint")
    rows_per_span = 1 << 16
    starts = chain_marks(follows, ["source_id", "island"], "at", "succ", lambda c: span_of(c, rows_per_span)).withColumn("head", F.col("at"))
    marked = x.join(starts, ["source_id", "island", "at"], "left")
    g = span_scan(marked, ["source_id", "island"], ["at"], span_of("at", rows_per_span), part=("upto", F.col("head")))
    cut = g.groupBy("source_id", "island", "part").agg(
        F.min("off").alias("m_off"), (F.max("__end") - F.min("off")).alias("m_len"), F.count("*").alias("members"))
    return cut.unionByName(whole)


def page_slices(ranges: DataFrame, page_size: int) -> DataFrame:
    """One row per page a range touches, with the slice of the page it needs."""
    off, end = F.col("off"), F.col("off") + F.col("len")
    x = ranges.where("len > 0").select("source_id", "idx", off.alias("__a"), end.alias("__b"))
    x = explode_range(x, F.floor(F.col("__a") / page_size), F.ceil(F.col("__b") / page_size), "page")
    base = F.col("page") * page_size
    return x.select("source_id", "idx", "page", (F.greatest(F.col("__a"), base) - base).alias("local_start"),
                    (F.least(F.col("__b"), base + page_size) - base).alias("local_end"))


def composite_layout(parts: DataFrame, key: str, order: Sequence[str], size: str, span: Column) -> DataFrame:
    """Start and end of each part when the parts of a key are laid end to end."""
    from .scan import span_scan
    x = span_scan(parts, [key], order, span, part_start=("sum_before", F.col(size)))
    return x.withColumn("part_end", F.col("part_start") + F.col(size))


def split_requests(layout: DataFrame, requests: DataFrame, key: str, width: float) -> DataFrame:
    """Requests (key, req_start, req_end) cut into the parts they cross, with local offsets."""
    hit = overlap_join(requests, layout, [key], "req_start", "req_end", "part_start", "part_end", width,
                       (F.col("part_end") > F.col("req_start")) & (F.col("part_start") < F.col("req_end"))
                       & (F.col("part_end") > F.col("part_start")))
    return hit.withColumn("local_start", F.greatest("req_start", "part_start") - F.col("part_start")).withColumn(
        "local_end", F.least("req_end", "part_end") - F.col("part_start"))


def compact_window(chunks: DataFrame, key: str, order: Sequence[str], size: str, span: Column) -> DataFrame:
    """New dense offsets of the selected chunks."""
    from .scan import span_scan
    return span_scan(chunks, [key], order, span, new_off=("sum_before", F.col(size)))


def read_amplification(counters: DataFrame, read: str, consumed: str) -> DataFrame:
    r, c = F.greatest(F.lit(0), F.col(read)), F.greatest(F.lit(0), F.col(consumed))
    ratio = F.when(c > 0, r / c).when(r > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return counters.withColumn("ratio", ratio).withColumn("overhead", F.greatest(F.lit(0), r - c))


def scale_projection(rows: DataFrame, seconds: str, fps: float = 30, packet_seconds: float = 1024 / 48000,
                     interleave_seconds: float = 1, keyframe_seconds: float = 2, tracks: int = 2,
                     max_table_bytes: int = 64 << 20) -> DataFrame:
    """Projected sample, chunk and key counts and the size of the sample tables of a long output."""
    d = F.greatest(F.lit(0.0), F.col(seconds))
    big = lambda c: F.ceil(c).cast("bigint")
    x = rows.withColumn("samples", big(d * max(0.0, fps)) + big(d / max(0.001, packet_seconds))).withColumn(
        "chunks", big(d / max(0.05, interleave_seconds)) * max(1, tracks)).withColumn(
        "keyframes", big(d / max(0.05, keyframe_seconds)))
    sizes, offsets = 20 + F.col("samples") * 4, 16 + F.col("chunks") * 8
    chunk_map = 16 + F.greatest(F.lit(1), F.least(F.col("chunks"), F.lit(tracks * 8))) * 12
    sync = F.when(F.col("keyframes") > 0, 16 + F.col("keyframes") * 4).otherwise(0)
    total = sizes + offsets + chunk_map + (16 + 8) + sync
    return x.withColumn("table_bytes", total.cast("bigint")).withColumn("too_big", F.col("table_bytes") > max_table_bytes)
