"""Column expressions shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"


def whole(text: Column) -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    plain = F.length(text) == F.octet_length(text)  # lower() is much faster and the same for ASCII
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def one_space(text: Column) -> Column:
    """Each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")


def hash_pair(*cols: Column) -> Column:
    """128 bits as two longs: two xxhash64 chains that start from different seeds."""
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def before_each(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each bigint of an array what the associative ``op`` makes of all values before it (``zero`` for the first).

    An array grows by copying it, so one pass over n values would copy n * n of them; blocks of about the root of n, then a pass over
    the blocks, copy n to the power 1.5.
    """
    unit = "struct<all:bigint,out:array<bigint>>"
    start = F.struct(zero.cast("bigint").alias("all"), F.array().cast("array<bigint>").alias("out"))

    def run(part: Column) -> Column:
        return F.aggregate(part, start, lambda a, x: F.struct(
            op(a["all"], x).cast("bigint").alias("all"), F.concat(a["out"], F.array(a["all"])).alias("out")).cast(unit))

    def whole_array(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: run(F.slice(v, k * width + 1, width)))
        return let(parts, lambda p: let(run(F.transform(p, lambda x: x["all"]))["out"], lambda base: F.flatten(
            F.transform(p, lambda x, k: F.transform(x["out"], lambda y: op(F.get(base, k), y).cast("bigint"))))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole_array(v)).otherwise(F.array().cast("array<bigint>")))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names that start with the stems and clash with no column of ``df`` (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def field(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(df: DataFrame, names: list[str], ddl: str) -> T.StructType:
    """The schema of the named columns of ``df`` followed by the fields of ``ddl``."""
    return T.StructType(df.select(*map(field, names)).schema.fields + T.StructType.fromDDL(ddl).fields)
