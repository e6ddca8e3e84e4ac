"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _stars(both: DataFrame) -> DataFrame:
    """(u, v, m): every neighbour v of u with the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has either one edge to a root, or is a root: all components are found."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count("*").alias("all")).where("up > 1 or (up = 1 and all > 1)")
    return bad.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (two columns of comparable ids); root is the least node of its component.

    Each step writes the edges once into the shared folder; a node's neighbours are never gathered, only their minimum.
    Loops and repeated edges do no harm; an empty table gives no rows.
    """
    a, b = edges.columns
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _is_stars(now):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = durable(_stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _stars(large).select(F.explode(F.array(  # u is above each of its neighbours here
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = durable(small.where("u <> v").distinct())
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_components(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) after further ``edges`` (x, y): only the roots that these touch are walked again."""
    known = durable(linked)
    for side in "xy":
        named = known.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        edges = edges.join(named, side, "left").withColumn(side, F.coalesce(f"r{side}", side)).drop(f"r{side}")
    moved = durable(components(edges.select("x", "y")))
    kept = known.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(
        "node", F.coalesce("to", "root").alias("root"))
    return kept.unionByName(moved.join(known.select("node"), "node", "left_anti"))
