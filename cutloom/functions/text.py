"""Tokenising: NFKC, lower case, runs of letters and digits."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

LEAST_RANGE = 16  # shorter ranges beyond U+0180 are left out of the pattern: what holds them is only normalized without need


@F.pandas_udf(T.StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@cache
def unstable() -> str:
    """Pattern of a character that NFKC may change, move or join to the one before it; text without any is in normal form.

    Left out are characters that are their own form, of combining class 0, and never second in a composition.
    """
    points = [*range(0x80, 0xD800), *range(0xE000, 0x30000)]
    second = {chr(c) for c in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD800))}
    second |= {chr(int(p[1], 16)) for c in points if len(p := unicodedata.decomposition(chr(c)).split()) == 2 and p[0][0] != "<"}
    ranges: list[list[int]] = []
    for c in points:
        x = chr(c)
        if x in second or unicodedata.combining(x) or not unicodedata.is_normalized("NFKC", x):
            continue
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    # a class of many ranges is slow: ASCII, accented letters and large alphabets are passed over before it is asked
    other = lambda least: "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges if b - a + 1 >= least or least < 99 and a < 0x180) + "]"
    return f"(?=[^\\x00-\\x7F])(?=[^\\xBF-\\x{{131}}])(?={other(128)}){other(LEAST_RANGE)}"


def nfkc(col: Column) -> Column:
    """NFKC; only texts with a character that it may change cross to Python, most alphabets and ideographs do not."""
    return F.coalesce(nfkc_udf(F.when((F.octet_length(col) > F.length(col)) & col.rlike(unstable()), col)), col)


def normalized(col: Column) -> Column:
    return F.lower(nfkc(col))


def tokens(col: Column) -> Column:
    """Array of terms in text order, repeats kept."""
    return F.regexp_extract_all(normalized(col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
