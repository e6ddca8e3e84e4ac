"""Canonical JSON and the 64-bit / 32-bit FNV-1a checksums used for durable ids."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# FNV-1a parameters.
GRID_BYTES = 1 << 24
FNV64_OFFSET, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
FNV32_OFFSET, FNV32_PRIME = 0x811C9DC5, 0x01000193


def _number(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("numbers must be finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" in text:
        mantissa, exponent = text.split("e")
        sign = "-" if exponent.startswith("-") else "+"
        digits = exponent.lstrip("+-").lstrip("0")
        mantissa = mantissa[:-2] if mantissa.endswith(".0") else mantissa
        if sign == "-" and int(digits) <= 6:
            return f"{x:.20f}".rstrip("0")
        return f"{mantissa}e{sign}{digits}"
    return text


def canonical(value) -> str:
    """JSON with keys sorted by UTF-16 units, no blanks, numbers in their shortest form."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else canonical(json.loads(x)))


def fnv64_texts(texts: list[str]) -> list[str]:
    """Checksums of many texts at once: each UTF-16 unit feeds its low byte, then its high byte.

    Texts go side by side in order of length, as many as fit ``GRID_BYTES``: one long text widens no other's row.
    """
    raw = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype=np.uint8) for t in texts]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    out = [""] * len(raw)
    start = 0
    while start < len(order):
        width = len(raw[order[start]])
        block = order[start:start + max(1, GRID_BYTES // max(1, width))]
        grid = np.zeros((width, len(block)), dtype=np.uint8)
        for col, i in enumerate(block):
            grid[:len(raw[i]), col] = raw[i]
        h = np.full(len(block), FNV64_OFFSET, dtype=np.uint64)
        lengths, live = [len(raw[i]) for i in block], len(block)
        for pos in range(width):
            while live and lengths[live - 1] <= pos:
                live -= 1
            h[:live] = (h[:live] ^ grid[pos, :live]) * np.uint64(FNV64_PRIME)
        for col, i in enumerate(block):
            out[i] = f"{int(h[col]):016x}"
        start += len(block)
    return out


@F.pandas_udf(T.StringType())
def fnv64(s: pd.Series) -> pd.Series:
    known = s.dropna()
    return pd.Series(fnv64_texts(list(known)), index=known.index, dtype=object).reindex(s.index)


@F.pandas_udf(T.StringType())
def fnv64_units(s: pd.Series) -> pd.Series:
    """Variant that feeds whole UTF-16 code units."""
    def one(text):
        h = FNV64_OFFSET
        for u in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16):
            h = ((h ^ int(u)) * FNV64_PRIME) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"
    return s.map(lambda x: None if x is None else one(x))


@F.pandas_udf(T.StringType())
def fnv32(s: pd.Series) -> pd.Series:
    """32-bit variant over the first UTF-16 unit of each character."""
    def one(text):
        h = FNV32_OFFSET
        for ch in text:
            c = ord(ch)
            unit = c if c < 0x10000 else 0xD800 + ((c - 0x10000) >> 10)
            h = ((h ^ unit) * FNV32_PRIME) & 0xFFFFFFFF
        return f"{h:08x}"
    return s.map(lambda x: None if x is None else one(x))


def register_sql(spark) -> None:
    """Make the UDFs callable from SQL by name."""
    for name, fn in {"canonical_json": canonical_json, "fnv64": fnv64, "fnv64_units": fnv64_units, "fnv32": fnv32}.items():
        spark.udf.register(name, fn)
