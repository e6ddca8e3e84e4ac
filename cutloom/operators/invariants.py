"""Rules that a project must keep, checked over time: which are broken when a log ends, and since which operation.

Ops are those of ``oplog``; a ``node.add`` also has a ``kind``, and ``edge.add`` rows with an ``edge_type`` other than ``contains`` (when the column is
there) play no part. A node lives from its add to its remove, an edge until its remove or that of either end. Every rule becomes a
sweep over the changes of one node: nothing is replayed state by state, and no project is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .oplog import first_failures
from .scan import asof, span_scan


@dataclass(frozen=True)
class ValueRule:
    """Property ``prop`` of nodes of a kind holds ``holds``, SQL over ``value``; a node without it has the default (null breaks the rule)."""

    kind: str
    prop: str
    code: str
    holds: str
    default: float | None = None


@dataclass(frozen=True)
class ParentRule:
    """A node of a kind has exactly one container of the ``parents`` kinds; with ``alone`` none of another kind either."""

    kind: str
    parents: tuple[str, ...]
    code: str
    alone: bool = False


#: Rule codes and bounds of projects.
RULES: tuple[ValueRule | ParentRule, ...] = (
    ValueRule("composition", "fps", "composition.fps", "value > 0"),
    ValueRule("composition", "duration", "composition.duration", "value >= 0"),
    ValueRule("clip", "start", "clip.start", "value >= 0"),
    ValueRule("clip", "duration", "clip.duration", "value > 0"),
    ValueRule("clip", "inPoint", "clip.in-point", "value >= 0", 0.0),
    ValueRule("clip", "playbackRate", "clip.playback-rate", "value > 0", 1.0),
    ValueRule("clip", "gainDb", "clip.gain-db", "value between -96 and 24", 0.0),
    ValueRule("clip", "pan", "clip.pan", "value between -1 and 1", 0.0),
    ValueRule("clip", "fadeIn", "clip.fade-in", "value >= 0", 0.0),
    ValueRule("clip", "fadeOut", "clip.fade-out", "value >= 0", 0.0),
    ParentRule("track", ("composition",), "track.parent"),
    ParentRule("object", ("project", "object"), "object.parent", alone=True),
    ParentRule("layer", ("composition",), "layer.parent"),
)

_NODE = ["project_id", "entity_id"]


def _array(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).cast("double") if n == "default" else F.lit(v) for n, v in zip(names, r))) for r in rows))


def _ends(flags: DataFrame, span: Column) -> DataFrame:
    """(project_id, entity_id, code, since) of (.., seq, broken): the keys whose last row is broken, and since when without a break."""
    keys = [*_NODE, "code"]
    x = span_scan(flags, keys, ["seq"], span, __was=("lag", F.col("broken")))
    start = F.max(F.when(F.col("broken") & ~F.coalesce("__was", F.lit(False)), F.col("seq")))
    ended = x.groupBy(*keys).agg(start.alias("since"), F.max(F.when(~F.col("broken"), F.col("seq"))).alias("__ok"))
    return ended.where("since > coalesce(__ok, -1)").drop("__ok")


def _broken_values(ops: DataFrame, rules: Sequence[ValueRule], span: Column) -> DataFrame:
    """A row when a node starts, when a ruled property is written, and when it ends."""
    alive = F.when(F.col("op_type") == "node.add", F.struct(F.col("kind").alias("kind"))).when(
        F.col("op_type") == "node.remove", F.struct(F.lit(None).cast("string").alias("kind")))
    x = span_scan(ops.where(F.col("op_type").startswith("node.")), _NODE, ["seq"], span, __of=("upto", alive), __had=("prev", alive))
    kind = F.coalesce("__of.kind", F.when(F.col("op_type") == "node.remove", F.col("__had.kind")))
    names = ["kind", "prop", "code", "default"]
    each = x.withColumn("__kind", kind).where("__kind is not null").withColumn("__r", F.explode(F.filter(
        _array([(r.kind, r.prop, r.code, r.default) for r in rules], ["col1", "col2", "col3", "default"]), lambda r: r["col1"] == F.col("__kind"))))
    fields = [F.col(f"__r.col{k + 1}") for k in range(len(names))]
    own = F.col("prop") == fields[1]
    each = each.where((F.col("op_type") != "node.update") | own)
    now = F.when((F.col("op_type") == "node.remove") | own, F.col("value")).otherwise(fields[3])
    each = each.select(*_NODE, "seq", "op_type", fields[2].alias("code"), now.alias("value"))
    holds = F.lit(False)
    for r in rules:
        holds = F.when(F.col("code") == r.code, F.coalesce(F.expr(r.holds), F.lit(False))).otherwise(holds)
    return _ends(each.select(*_NODE, "seq", "code", ((F.col("op_type") != "node.remove") & ~holds).alias("broken")), span)


def _containment(ops: DataFrame, span: Column, width: float) -> DataFrame:
    """(project_id, child, parent_kind, opened, closed) of containing edges; ``closed`` is null while they hold."""
    edges = ops.where("op_type in ('edge.add', 'edge.remove')")
    if "edge_type" in ops.columns:
        edges = edges.where("op_type = 'edge.remove' or edge_type = 'contains'")
    gone = F.when(F.col("op_type") == "edge.remove", F.col("seq"))
    e = span_scan(edges, ["project_id", "edge_id"], ["seq"], span, __gone=("next", gone)).where("op_type = 'edge.add'")
    e = e.select("project_id", "seq", "__gone", F.col("entity_id").alias("parent"), F.col("other_id").alias("child"))
    life = ops.where("op_type in ('node.add', 'node.remove')").select(*_NODE, "seq", "kind", (F.col("op_type") == "node.remove").alias("dead"))
    births, deaths = life.where("not dead"), life.where("dead")
    for end in ("parent", "child"):
        named = lambda d, end=end: d.withColumnRenamed("entity_id", end)
        e = asof(named(deaths), e, ["project_id", end], "seq", "seq", ["seq"], "seq", width).select(
            *e.columns, F.col("right.seq").alias(f"__{end}"))
    e = asof(births.withColumnRenamed("entity_id", "parent"), e, ["project_id", "parent"], "seq", "seq", ["kind"], "seq", width).select(
        *e.columns, F.col("left.kind").alias("parent_kind"))
    return e.select("project_id", F.col("child").alias("entity_id"), "parent_kind", F.col("seq").alias("opened"),
                    F.least("__gone", "__parent", "__child").alias("closed"))


def _broken_parents(ops: DataFrame, rules: Sequence[ParentRule], span: Column, width: float) -> DataFrame:
    """A row per child and operation that changes its life or its containers, with the counts after it."""
    e = _containment(ops, span, width)
    steps = e.select(*_NODE, "parent_kind", F.explode(F.array(
        F.struct(F.col("opened").alias("seq"), F.lit(1).alias("d")), F.struct(F.col("closed").alias("seq"), F.lit(-1).alias("d")))).alias("s")).select(
        *_NODE, "parent_kind", "s.*").where("seq is not null")
    kinds = sorted({k for r in rules for k in r.parents})
    counted = [F.sum(F.when(F.col("parent_kind") == k, F.col("d")).otherwise(0)).alias(f"__d{i}") for i, k in enumerate(kinds)]
    moves = steps.groupBy(*_NODE, "seq").agg(F.sum("d").alias("__all"), *counted)
    state = F.struct(F.when(F.col("op_type") == "node.add", F.col("kind")).alias("kind"))
    lives = ops.where("op_type in ('node.add', 'node.remove')").groupBy(*_NODE, "seq").agg(F.max(state).alias("__life"))
    x = moves.join(lives, [*_NODE, "seq"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = {f"__s{i}": ("sum", zero(f"__d{i}")) for i in range(len(kinds))}
    x = span_scan(x, _NODE, ["seq"], span, __total=("sum", zero("__all")), __now=("upto", F.col("__life")), __had=("prev", F.col("__life")), **sums)
    told = []
    for r in rules:
        fit = sum((F.col(f"__s{kinds.index(k)}") for k in r.parents), F.lit(0))
        bad = (fit != 1) | ((F.col("__total") != 1) if r.alone else F.lit(False))
        mine = (F.col("__now.kind") == r.kind)
        told.append(F.when(mine | (F.col("__had.kind") == r.kind), F.struct(F.lit(r.code).alias("code"), (F.coalesce(mine, F.lit(False)) & bad).alias("broken"))))
    flags = x.select(*_NODE, "seq", F.explode(F.array_compact(F.array(*told))).alias("f")).select(*_NODE, "seq", "f.*")
    return _ends(flags, span)


def broken_rules(ops: DataFrame, span: Column, span_width: float, rules: Sequence[ValueRule | ParentRule] = RULES) -> DataFrame:
    """(project_id, entity_id, code, since): rules that nodes break after the last op, each with the op since which it has been broken.

    Ops are taken to apply: run ``first_failures`` first, or use ``preflight``.
    """
    values, parents = ([r for r in rules if isinstance(r, t)] for t in (ValueRule, ParentRule))
    parts = ([_broken_values(ops, values, span)] if values else []) + ([_broken_parents(ops, parents, span, span_width)] if parents else [])
    if not parts:
        raise ValueError("no rules")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preflight(ops: DataFrame, span: Column, span_width: float, roots: DataFrame | None = None,
              rules: Sequence[ValueRule | ParentRule] = RULES) -> DataFrame:
    """(project_id, seq, phase, code) of projects whose batch is refused: schema before apply before invariants.

    Rules are judged on what the whole batch leaves; ``seq`` is then the earliest op since which one of the broken rules has been broken (of
    several, the first code). A rule that is broken and mended within the batch does no harm.
    """
    failed = first_failures(ops, span, span_width, roots)
    ends = broken_rules(ops, span, span_width, rules).groupBy("project_id").agg(F.min(F.struct(F.col("since").alias("seq"), "code")).alias("f"))
    late = ends.join(failed.select("project_id"), "project_id", "left_anti").select("project_id", "f.seq", F.lit("invariants").alias("phase"), "f.code")
    return failed.unionByName(late)
