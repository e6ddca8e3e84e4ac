"""Operation logs: chains, replay, as-of state, checks and batches.

Ops: project_id, seq (1-based), tx_id, op_type, entity_id, prop, value. An ``edge.add`` links ``entity_id`` to
``other_id`` under ``edge_id``; an ``edge.remove`` names that id.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.hashing import fnv64_texts
from .fold import ordered_fold
from .scan import asof, span_scan

DIGESTS = {"sha256": lambda text: hashlib.sha256(text.encode()).hexdigest(), "fnv64": lambda text: fnv64_texts([text])[0]}


def append_chain(entries: DataFrame, digest: str = "sha256") -> DataFrame:
    """Add ``previous`` and ``checksum`` along (project_id, seq): each checksum covers the one before it.

    The chain is sequential by definition; rows stream through one task per project with one checksum as state.
    """
    make = DIGESTS[digest]

    def step(state, values):
        seq, payload = values
        mark = make(f"{state or ''}|{seq}|{payload}")
        return mark, (state, mark)

    return ordered_fold(entries, ["project_id"], ["seq"], lambda: None, step, ["seq", "payload"],
                        "previous string, checksum string")


def chain_text(previous: Column, seq: Column, payload: Column) -> Column:
    return F.concat_ws("|", F.coalesce(previous, F.lit("")), seq.cast("string"), payload)


def chain_violations(entries: DataFrame, span: Column, checksum: Column | None = None) -> DataFrame:
    """(project_id, seq, code): gaps, broken links and wrong checksums; every row is checked on its own."""
    expected = checksum if checksum is not None else F.sha2(chain_text(F.col("previous"), F.col("seq"), F.col("payload")), 256)
    x = span_scan(entries, ["project_id"], ["seq", "tx_id"], span, __n=("row_number",), __before=("lag", F.col("checksum")))
    codes = F.array_compact(F.array(F.when(F.col("seq") != F.col("__n"), F.lit("sequence-gap")),
                                    F.when(~F.col("previous").eqNullSafe(F.col("__before")), F.lit("chain-mismatch")),
                                    F.when(~F.col("checksum").eqNullSafe(expected), F.lit("checksum-mismatch"))))
    return x.select("project_id", "seq", F.explode(codes).alias("code"))


def heads(log: DataFrame) -> DataFrame:
    return log.groupBy("project_id").agg(F.max("seq").alias("head_seq"), F.max_by("tx_id", "seq").alias("head_tx"))


def truncate(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries up to each project's mark (project_id, upto)."""
    return log.join(marks, "project_id").where(F.col("seq") <= F.col("upto")).drop("upto")


def tail(log: DataFrame, after: DataFrame, limit: int) -> DataFrame:
    """The next ``limit`` entries after each project's position (project_id, after_seq); pruned map-side."""
    x = log.join(after, "project_id").where(F.col("seq") > F.col("after_seq")).drop("after_seq")
    w = W.partitionBy("project_id").orderBy("seq")
    return x.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")


# --- state ------------------------------------------------------------------------------------------------------------

def replay_nodes(ops: DataFrame, keys: tuple = ("project_id",)) -> DataFrame:
    """(keys.., entity_id, prop, value) after all ops: the last add opens a node, later updates win per property.

    Two hash aggregates and one join; no project is ever gathered. Updates of a node that is absent have no effect.
    """
    k = [*keys, "entity_id"]
    life = ops.where("op_type in ('node.add', 'node.remove')").groupBy(*k).agg(
        F.max(F.struct("seq", "op_type")).alias("__l"))
    alive = life.where("__l.op_type = 'node.add'").select(*k, F.col("__l.seq").alias("__born"))
    x = ops.where("op_type in ('node.add', 'node.update')").join(alive, k).where(F.col("seq") >= F.col("__born"))
    return x.groupBy(*k, "prop").agg(F.max_by("value", "seq").alias("value"))


def replay_edges(ops: DataFrame, keys: tuple = ("project_id",)) -> DataFrame:
    """(keys.., edge_id, src, dst): edges whose last add or remove is an add, with neither end removed after it."""
    k = [*keys, "edge_id"]
    last = ops.where("op_type in ('edge.add', 'edge.remove')").groupBy(*k).agg(
        F.max(F.struct("seq", "op_type", F.col("entity_id").alias("src"), F.col("other_id").alias("dst"))).alias("__l"))
    e = last.where("__l.op_type = 'edge.add'").select(*k, "__l.seq", "__l.src", "__l.dst")
    gone = ops.where("op_type = 'node.remove'").groupBy(*keys, "entity_id").agg(F.max("seq").alias("__gone"))
    for end in ("src", "dst"):
        g = gone.select(*keys, F.col("entity_id").alias(end), F.col("__gone").alias(f"__g_{end}"))
        e = e.join(g, [*keys, end], "left")
    ok = lambda end: F.col(f"__g_{end}").isNull() | (F.col(f"__g_{end}") < F.col("seq"))
    return e.where(ok("src") & ok("dst")).select(*k, "src", "dst")


def states_at(ops: DataFrame, marks: DataFrame) -> DataFrame:
    """Node state as of several marks (project_id, mark, upto) at once."""
    x = ops.join(marks, "project_id").where(F.col("seq") <= F.col("upto"))
    return replay_nodes(x, ("project_id", "mark"))


def state_difference(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows only in one of two states, with ``side``; empty when recovery is exact."""
    s = stored.select(*replayed.columns)
    return replayed.exceptAll(s).withColumn("side", F.lit("replayed")).unionByName(
        s.exceptAll(replayed).withColumn("side", F.lit("stored")))


def first_failures(ops: DataFrame, span: Column, span_width: float, roots: DataFrame | None = None) -> DataFrame:
    """First op of each project that cannot apply: (project_id, seq, phase, code).

    Unknown op types fail the whole log before anything is applied. An add of a node or edge that is there fails, an update
    of a node that is not, an edge with an end that is not, and the removal of a root (project_id, entity_id). Removing what
    is absent changes nothing. All ops before the first failure are valid, so what they leave is right where it is used.
    """
    node = F.col("op_type").isin("node.add", "node.remove")
    exists = F.when(F.col("op_type") == "node.add", True).when(F.col("op_type") == "node.remove", False)
    n = span_scan(ops.where(F.col("op_type").startswith("node.")), ["project_id", "entity_id"], ["seq"], span, __there=("prev", exists))
    there = F.coalesce("__there", F.lit(False))
    if roots is not None:
        n = n.join(roots.select("project_id", "entity_id", F.lit(True).alias("__root")), ["project_id", "entity_id"], "left")
    root = F.coalesce("__root", F.lit(False)) if roots is not None else F.lit(False)
    n_code = (F.when((F.col("op_type") == "node.add") & there, "already-exists")
              .when((F.col("op_type") == "node.update") & ~there, "unknown-node")
              .when((F.col("op_type") == "node.remove") & root, "project-root"))
    last = F.struct(F.col("seq").alias("at"), "op_type", F.col("entity_id").alias("src"), F.col("other_id").alias("dst"))
    e = span_scan(ops.where("op_type in ('edge.add', 'edge.remove')"), ["project_id", "edge_id"], ["seq"], span, __last=("prev", last))
    e = e.where("op_type = 'edge.add'")
    open_ = F.when(F.col("__last.op_type") == "edge.add", F.col("__last"))
    ends = e.select("project_id", "seq", F.explode(F.array(
        F.struct(F.col("entity_id").alias("entity_id"), F.lit(None).cast("bigint").alias("since")),
        F.struct(F.col("other_id").alias("entity_id"), F.lit(None).cast("bigint").alias("since")),
        F.struct(open_["src"].alias("entity_id"), open_["at"].cast("bigint").alias("since")),
        F.struct(open_["dst"].alias("entity_id"), open_["at"].cast("bigint").alias("since")))).alias("p")).select(
            "project_id", "p.*", F.col("seq").alias("at")).where("entity_id is not null")
    life = ops.where(node).select("project_id", "entity_id", "seq", "op_type")
    state = asof(life, ends, ["project_id", "entity_id"], "seq", "at", ["op_type"], "seq", span_width).withColumn(
        "__now", F.col("left.op_type")).drop("left", "right")
    state = asof(life.where("op_type = 'node.remove'"), state, ["project_id", "entity_id"], "seq", "at", ["op_type"], "seq", span_width)
    flags = state.groupBy("project_id", F.col("at").alias("seq")).agg(
        F.max(F.col("since").isNull() & ~F.col("__now").eqNullSafe("node.add")).alias("__lost"),
        F.count("since").alias("__open"), F.max(F.col("since").isNotNull() & F.coalesce(F.col("left.time") > F.col("since"), F.lit(False))).alias("__cut"))
    e_code = F.when((F.col("__open") > 0) & ~F.col("__cut"), "edge-exists").when(F.col("__lost"), "unknown-node")
    known = F.col("op_type").isin("node.add", "node.update", "node.remove", "edge.add", "edge.remove")
    bad = ops.where(~known).select("project_id", "seq", F.lit("schema").alias("phase"), F.lit("unsupported-operation").alias("code"))
    for part, code in ((n, n_code), (flags, e_code)):
        bad = bad.unionByName(part.select("project_id", "seq", F.lit("apply").alias("phase"), code.alias("code")).where("code is not null"))
    first = F.min(F.struct((F.col("phase") == "apply").alias("late"), "seq", "phase", "code")).alias("f")
    return bad.groupBy("project_id").agg(first).select("project_id", "f.seq", "f.phase", "f.code")


def review_changes(ops: DataFrame, span: Column) -> DataFrame:
    """Before and after of every property written: (project_id, seq, entity_id, prop, before, after).

    Values do not survive a remove or a new add, so the life of the entity is part of the key.
    """
    edge = F.when(F.col("op_type").isin("node.add", "node.remove"), 1).otherwise(0).cast("bigint")
    x = span_scan(ops, ["project_id", "entity_id"], ["seq"], span, __life=("sum", edge))
    w = x.where("op_type in ('node.add', 'node.update')")
    y = span_scan(w, ["project_id", "entity_id", "prop", "__life"], ["seq"], span, before=("lag", F.col("value")))
    return y.where("op_type = 'node.update'").select("project_id", "seq", "entity_id", "prop", "before", F.col("value").alias("after"))


# --- batches ----------------------------------------------------------------------------------------------------------

def batch_verdicts(batches: DataFrame, allowed: DataFrame, now_ms: int, max_age_ms: int | None) -> DataFrame:
    """Batches (batch_id, project_id, target_project, actor_id, issued_at) with a verdict code."""
    x = batches.join(allowed.select("actor_id", F.lit(True).alias("__ok")).distinct(), "actor_id", "left")
    age = F.lit(now_ms) - F.col("issued_at")
    code = F.when(F.col("project_id") != F.col("target_project"), "project-mismatch").when(F.col("__ok").isNull(), "actor-not-allowed")
    if max_age_ms is not None:
        code = code.when(F.col("issued_at").isNull(), "issued-at-required").when((age < 0) | (age > max_age_ms), "outside-window")
    return x.withColumn("verdict", code.otherwise("accepted")).drop("__ok")


def append_if_current(batches: DataFrame, log: DataFrame) -> DataFrame:
    """Batches (batch_id, project_id, previous_seq, previous_tx): accepted when the head still is what they built on.

    The least batch_id of those that name the head is accepted; it moves the head, so all others are stale.
    """
    x = batches.join(heads(log), "project_id", "left")
    same = (F.coalesce("head_seq", F.lit(0)) == F.col("previous_seq")) & F.col("head_tx").eqNullSafe(F.col("previous_tx"))
    x = x.select("batch_id", "project_id", same.alias("__same"))
    first = x.where("__same").groupBy("project_id").agg(F.min("batch_id").alias("__first"))
    return x.join(first, "project_id", "left").select("batch_id", "project_id", F.when(
        F.col("__same") & (F.col("batch_id") == F.col("__first")), "accepted").otherwise("stale").alias("status"))


def stale_proposals(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Proposals (plan_id, project_id, base_fingerprint) against (project_id, fingerprint)."""
    x = proposals.join(current.select("project_id", "fingerprint"), "project_id", "left")
    return x.select("plan_id", "project_id", (~F.col("base_fingerprint").eqNullSafe(F.col("fingerprint"))).alias("stale"))


def select_plan_ops(ops: DataFrame, picks: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen operations in order, and picks refused as out of range or repeated: picks are (plan_id, op_idx)."""
    p = picks.groupBy("plan_id", "op_idx").agg(F.count("*").alias("__n")).join(sizes, "plan_id", "left")
    reason = F.when(F.col("size").isNull() | (F.col("op_idx") < 0) | (F.col("op_idx") >= F.col("size")), "out-of-range").when(
        F.col("__n") > 1, "duplicate")
    p = p.withColumn("reason", reason)
    return (ops.join(p.where("reason is null").select("plan_id", "op_idx"), ["plan_id", "op_idx"], "left_semi"),
            p.where("reason is not null").select("plan_id", "op_idx", "reason"))


def compact(spark: SparkSession, folder: str, expected_version: int, state: DataFrame) -> int:
    """Write ``state`` as the next base version of a log store, refusing when the head moved.

    Versions are folders ``version=N``. The write fails if version N+1 already exists, so of two writers that started
    from the same head at most one succeeds. Parquet has no locks: keep one compaction job per store.
    """
    target = f"{folder}/version={expected_version + 1}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if expected_version and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={expected_version}/_SUCCESS")):
        raise RuntimeError(f"version {expected_version} is not the head of {folder}")
    if fs.exists(path):
        raise RuntimeError(f"head moved: version {expected_version + 1} exists")
    state.write.mode("errorifexists").parquet(target)
    return expected_version + 1
