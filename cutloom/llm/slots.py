"""A bit table of fixed size that tells most rows apart from a key set before anything is shuffled."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import field

WORDS = 1 << 16  # 64-bit words: 512 KB whatever the input
MOST_WORDS = 1 << 21  # 16 MB
BITS_PER_KEY = 16


def bit_table(keys: DataFrame, names: list[str], words: int = WORDS) -> DataFrame:
    """One row ``bits``: an array of ``words`` longs with the slot of each key set."""
    slot = F.pmod(F.xxhash64(*map(field, names)), F.lit(words * 64))
    held = keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v"))
    zeros = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    every = zeros.unionByName(held).groupBy("w").agg(F.bit_or("v").alias("v"))
    bits = F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])
    return durable(every.agg(bits.alias("bits")))


def may_hold(bits: Column, names: list[str], words: int = WORDS) -> Column:
    """False only if the row's key is not in the table; true for few others as long as the keys are fewer than the bits."""
    slot = F.pmod(F.xxhash64(*map(field, names)), F.lit(words * 64))
    word = F.element_at(bits, (F.floor(slot / 64) + 1).cast("int"))
    return F.call_function("getbit", word, (slot % 64).cast("int")) == 1


def mark(df: DataFrame, table: DataFrame, names: list[str], out: str, words: int = WORDS) -> DataFrame:
    """``df`` with the boolean column ``out``: whether the table may hold the row's key."""
    both = df.crossJoin(F.broadcast(table.withColumnRenamed("bits", f"{out}_bits")))
    return both.withColumn(out, may_hold(field(f"{out}_bits"), names, words)).drop(f"{out}_bits")


def fitting_words(count: int) -> int | None:
    """Words of a table that tells ``count`` keys well apart from others; None if it would be larger than MOST_WORDS."""
    words = 1 << max(10, (count * BITS_PER_KEY // 64).bit_length())
    return words if words <= MOST_WORDS else None


def likely_held(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``df`` whose key is among ``keys``, and maybe a few more; ``keys`` is read twice, repeated ones do no harm.

    Told by a bit table sized by about how many keys differ, beyond MOST_WORDS by a semi-join. A null is equal to a null.
    """
    few = keys.agg(F.approx_count_distinct(F.xxhash64(*map(field, names)), 0.03)).first()[0]
    words = fitting_words(few)
    if words is None:
        held = keys.select(*(field(n).alias(f"__k{i}") for i, n in enumerate(names))).distinct()
        return df.join(held, reduce(and_, (field(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names))), "left_semi")
    return mark(df, bit_table(keys, names, words), names, "__held", words).where("__held").drop("__held")
