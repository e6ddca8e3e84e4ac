"""Property-graph tables: lookups, neighbourhoods, closures, rewiring and bulk changes.

Nodes: id, kind, name, ...; edges: src, dst, type, ... Iterative operators materialise each level with ``durable`` so
that neither the plan nor a lost executor makes them start over.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable


def nodes_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def edges_between(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """Edges at each given node (column ``id`` of ``nodes``)."""
    end = "src" if direction == "out" else "dst"
    e = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    return nodes.select(F.col(node_id).alias("id")).join(e, F.col("id") == F.col(end))


def linked(edges: DataFrame, nodes: DataFrame, edge_type: str, kind: str | None = None) -> DataFrame:
    """(src, id, kind, name): targets of every edge of a type that exist, optionally of one kind."""
    n = nodes if kind is None else nodes.where(F.col("kind") == kind)
    return edges.where(F.col("type") == edge_type).select("src", F.col("dst").alias("id")).join(n, "id")


def consumers(edges: DataFrame, nodes: DataFrame, assets: DataFrame, kinds: Sequence[str] = ("clip", "layer")) -> DataFrame:
    """(asset_id, id, kind): nodes of the consumer kinds that reference each asset, once each."""
    e = edges.where("type = 'references'").select(F.col("src").alias("id"), F.col("dst").alias("asset_id")).distinct()
    return e.join(assets.select("asset_id"), "asset_id", "left_semi").join(
        nodes.where(F.col("kind").isin(*kinds)).select("id", "kind"), "id")


def find_objects(objects: DataFrame, object_type: str | None = None, semantic_id: str | None = None, tag: str | None = None,
                 name: str | None = None) -> DataFrame:
    o = objects
    if object_type:
        o = o.where(F.col("object_type") == object_type)
    if semantic_id:
        o = o.where(F.col("semantic_id") == semantic_id)
    if tag:
        o = o.where(F.array_contains("tags", tag))
    if name:
        o = o.where(F.lower("name").contains(name.lower()))
    return o


def relationships(relations: DataFrame, role: str | None = None) -> DataFrame:
    return relations if role is None else relations.where(F.col("role") == role)


def _step(edges: DataFrame, front: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(id, ..): other ends of the edges at the front; two equi joins, so a small front is broadcast by AQE."""
    f = front.select(F.col("id").alias("__f"))
    out = edges.join(f, F.col("src") == F.col("__f"), "left_semi").select(F.col("dst").alias("id"), *extra)
    back = edges.join(f, F.col("dst") == F.col("__f"), "left_semi").select(F.col("src").alias("id"), *extra)
    return out.unionByName(back)


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int, visible: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """(id, level): nodes within ``depth`` undirected steps of the focus ids; the root is reached but not walked through."""
    seen = durable(focus.select("id").distinct().withColumn("level", F.lit(0).cast("bigint")))
    if visible is not None:
        seen = seen.join(visible.select("id"), "id", "left_semi")
    front = seen
    for level in range(1, depth + 1):
        start = front if root is None else front.where(F.col("id") != root)
        found = _step(edges, start).distinct()
        found = found.join(seen, "id", "left_anti")
        if visible is not None:
            found = found.join(visible.select("id"), "id", "left_semi")
        front = durable(found.withColumn("level", F.lit(level).cast("bigint")))
        seen = seen.unionByName(front)
    return seen


def capped_neighbourhood(edges: DataFrame, focus: DataFrame, depth: int, max_nodes: int, visible: DataFrame | None = None,
                         root: str | None = None) -> DataFrame:
    """``neighbourhood`` with a node cap: within a level nodes are taken in edge-id order until the cap is reached.

    The cap is part of the request (a bounded context), so each level keeps at most ``max_nodes`` rows by a top-k.
    """
    ids = focus.select("id").distinct()
    if root is not None:
        ids = ids.unionByName(edges.sparkSession.createDataFrame([(root,)], ids.schema)).distinct()
    if visible is not None:
        ids = ids.join(visible.select("id"), "id", "left_semi")
    first = ids.orderBy(F.lit(1) if root is None else F.col("id") != root, "id").limit(max_nodes)
    seen = durable(first.withColumn("level", F.lit(0).cast("bigint")))
    room = max_nodes - seen.count()
    front = seen
    for level in range(1, depth + 1):
        if room <= 0:
            break
        start = front if root is None else front.where(F.col("id") != root)
        found = _step(edges, start, ["edge_id"])
        found = found.join(seen, "id", "left_anti")
        if visible is not None:
            found = found.join(visible.select("id"), "id", "left_semi")
        picked = found.groupBy("id").agg(F.min("edge_id").alias("edge_id")).orderBy("edge_id", "id").limit(room)
        front = durable(picked.select("id", F.lit(level).cast("bigint").alias("level")))
        room -= front.count()
        seen = seen.unionByName(front)
    return seen


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends included."""
    keep = ids.select("id")
    return edges.join(keep, F.col("src") == keep["id"], "left_semi").join(keep, F.col("dst") == keep["id"], "left_semi")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): all ancestors of every node along ``edges``, shortest depth; cycles end by themselves."""
    base = edges.select("src", "dst").distinct()
    reach = durable(base.withColumn("depth", F.lit(1).cast("bigint")))
    front = reach
    for depth in count(2):  # ends when a step finds nothing new
        step = front.select("src", F.col("dst").alias("mid")).join(
            base.select(F.col("src").alias("mid"), F.col("dst").alias("next")), "mid").select("src", F.col("next").alias("dst"))
        new = step.distinct().join(reach.select("src", "dst"), ["src", "dst"], "left_anti")
        front = durable(new.withColumn("depth", F.lit(depth).cast("bigint")))
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return reach


def endless_chains(parents: DataFrame) -> DataFrame:
    """Ids (id, parent) whose chain of parents never ends: members of a cycle and everything that hangs below one.

    Pointer doubling: each round doubles the jump and drops chains that ended. Chain lengths have no holes, so a round
    that drops nothing proves that only endless chains are left: log2(longest chain) rounds.
    """
    jump = durable(parents.where("parent is not null").select("id", F.col("parent").alias("to")))
    left = jump.count()
    while left:
        nxt = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("__far")), "to").select("id", F.col("__far").alias("to"))
        jump = durable(nxt)
        now = jump.count()
        if now == left:
            break
        left = now
    return jump.select("id")


def representations(relations: DataFrame, nodes: DataFrame, clip_assets: DataFrame) -> DataFrame:
    """(object_id, asset_id, edge_id, target_id, role): every way an object reaches an asset, directly or by clip / layer."""
    via = relations.join(clip_assets.select(F.col("clip_id").alias("target_id"), "asset_id"), "target_id")
    direct = relations.join(nodes.where("kind = 'asset'").select(F.col("id").alias("target_id")), "target_id").withColumn(
        "asset_id", F.col("target_id"))
    return direct.unionByName(via).select("object_id", "asset_id", "edge_id", "target_id", F.coalesce("role", F.lit("related")).alias("role"))


def representation_summary(reps: DataFrame) -> DataFrame:
    """Per object and asset: counts of distinct relations and targets, and the sorted roles (roles are few)."""
    edges = reps.select("object_id", "asset_id", "edge_id").distinct().groupBy("object_id", "asset_id").agg(F.count("*").alias("relations"))
    targets = reps.select("object_id", "asset_id", "target_id").distinct().groupBy("object_id", "asset_id").agg(F.count("*").alias("targets"))
    roles = reps.select("object_id", "asset_id", "role").distinct().groupBy("object_id", "asset_id").agg(
        F.array_join(F.sort_array(F.collect_list("role")), ",").alias("roles"))
    return edges.join(targets, ["object_id", "asset_id"]).join(roles, ["object_id", "asset_id"])


def render_closure(edges: DataFrame, compositions: DataFrame, clips: DataFrame) -> DataFrame:
    """(composition_id, id): what a render depends on: the composition, its direct children, the clips (clip_id, track_id) on
    those, and effects that target any of them or such effects, to a fixpoint. A composition inside another one counts as a
    child only; its own content is not followed."""
    down = edges.where("type = 'contains'").select(F.col("src").alias("composition_id"), F.col("dst").alias("id"))
    aimed = edges.where("type = 'targets'").select(F.col("dst").alias("at"), F.col("src").alias("id"))
    roots = compositions.select(F.col("id").alias("composition_id"), "id")
    held = roots.unionByName(down.join(compositions.select(F.col("id").alias("composition_id")), "composition_id", "left_semi"))
    on = clips.select(F.col("track_id").alias("at"), F.col("clip_id").alias("id"))
    placed = held.withColumnRenamed("id", "at").join(on, "at").select("composition_id", "id")
    reach = durable(held.unionByName(placed).distinct())
    front = reach
    while True:
        new = front.withColumnRenamed("id", "at").join(aimed, "at").select("composition_id", "id").distinct().join(
            reach, ["composition_id", "id"], "left_anti")
        front = durable(new)
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return reach


def row_digest(columns: Sequence[str]) -> Column:
    """60-bit digest of named columns, for order-free fingerprints."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def fingerprint(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group.., fingerprint, rows): XOR of row digests, so no ordered copy of a group is ever built.

    Rows must be distinct inside a group (they are keyed by id); timestamps are left out by not naming them.
    """
    return rows.groupBy(*groups).agg(F.lower(F.hex(F.bit_xor(row_digest(columns)))).alias("fingerprint"), F.count("*").alias("rows"))


def replace_assets(requests: DataFrame, edges: DataFrame, nodes: DataFrame, assets: DataFrame,
                   kinds: Sequence[str] = ("clip", "layer")) -> tuple[DataFrame, DataFrame]:
    """Rewire consumers from ``source_asset`` to ``replacement_asset``.

    Returns (ops, rejects). Ops are (source_asset, consumer, op_idx, op_type, target): update, edge.remove, edge.add.
    A request is refused when an asset is unknown, both are equal or the asset families differ; a consumer when it does
    not hold exactly one reference edge to the source.
    """
    a = assets.select(F.col("asset_id"), F.col("asset_kind"))
    r = requests.join(a.select(F.col("asset_id").alias("source_asset"), F.col("asset_kind").alias("__s")), "source_asset", "left").join(
        a.select(F.col("asset_id").alias("replacement_asset"), F.col("asset_kind").alias("__r")), "replacement_asset", "left")
    r = r.withColumn("reason", F.when(F.col("__s").isNull() | F.col("__r").isNull(), "unknown-asset").when(
        F.col("source_asset") == F.col("replacement_asset"), "same-asset").when(F.col("__s") != F.col("__r"), "different-kind"))
    refs = edges.where("type = 'references'").groupBy(F.col("src").alias("consumer"), F.col("dst").alias("source_asset")).agg(
        F.count("*").alias("__n"))
    refs = refs.join(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("consumer")), "consumer", "left_semi")
    good = r.where("reason is null").select("source_asset", "replacement_asset").join(refs, "source_asset")
    rejects = r.where("reason is not null").select("source_asset", F.lit(None).cast("string").alias("consumer"), "reason").unionByName(
        good.where("__n <> 1").select("source_asset", "consumer", F.lit("reference-count").alias("reason")))
    op = lambda i, kind, target: F.struct(F.lit(i).alias("op_idx"), F.lit(kind).alias("op_type"), target.alias("target"))
    ops = good.where("__n = 1").select("source_asset", "consumer", F.explode(F.array(
        op(0, "node.update", F.col("replacement_asset")), op(1, "edge.remove", F.col("source_asset")),
        op(2, "edge.add", F.col("replacement_asset")))).alias("o")).select("source_asset", "consumer", "o.*")
    return ops, rejects


def plan_impact(ops: DataFrame, plan: str, entity: str) -> DataFrame:
    """Per plan: operations by type and distinct touched nodes and edges (two-step distinct counts)."""
    cells = ops.groupBy(plan, "op_type", entity).agg(F.count("*").alias("__n"))
    counts = cells.groupBy(plan).agg(F.sum("__n").alias("operations"), *[
        F.sum(F.when(F.col("op_type") == k, F.col("__n")).otherwise(0)).alias(k.replace(".", "_"))
        for k in ("node.add", "node.update", "node.remove", "edge.add", "edge.remove")])
    scope = cells.select(plan, F.substring_index("op_type", ".", 1).alias("__s"), entity).distinct()
    touched = scope.groupBy(plan).agg(F.count(F.when(F.col("__s") == "node", 1)).alias("nodes"),
                                      F.count(F.when(F.col("__s") == "edge", 1)).alias("edges"))
    return counts.join(touched, plan)


def upsert_objects(detections: DataFrame, objects: DataFrame) -> DataFrame:
    """Detections (detection_id, semantic_id, object_type, attributes map) against objects (object_id, semantic_id, ..).

    ``action``: create, merge (existing or created earlier in the batch), or error-ambiguous / error-type. A merge lets
    new attribute keys win. Without a semantic id a detection always creates.
    """
    known = objects.where("semantic_id is not null").groupBy("semantic_id").agg(
        F.count("*").alias("__n"), F.min("object_id").alias("__id"), F.min_by("object_type", "object_id").alias("__type"),
        F.min_by("attributes", "object_id").alias("__attrs"))
    first = detections.where("semantic_id is not null").groupBy("semantic_id").agg(
        F.min(F.struct("detection_id", "object_type")).alias("__first"))
    x = detections.join(known, "semantic_id", "left").join(first, "semantic_id", "left")
    fresh = F.col("__n").isNull()
    kind = F.when(fresh, F.col("__first.object_type")).otherwise(F.col("__type"))
    action = (F.when(F.col("semantic_id").isNull(), "create").when(F.col("__n") > 1, "error-ambiguous")
              .when(fresh & (F.col("detection_id") == F.col("__first.detection_id")), "create")
              .when(kind != F.col("object_type"), "error-type").otherwise("merge"))
    x = x.withColumn("action", action)
    merged = F.when((F.col("action") == "merge") & ~fresh, F.map_zip_with(
        F.col("__attrs"), F.col("attributes"), lambda k, old, new: F.coalesce(new, old))).when(
        F.col("action").isin("merge", "create"), F.col("attributes"))
    return x.select("detection_id", "semantic_id", "action", F.when(~fresh & (F.col("action") == "merge"), F.col("__id")).alias("object_id"),
                    merged.alias("attributes"))


def relation_changes(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (src, dst, role, props) against existing relations (edge_id, src, dst, role, props): skip, replace or insert.

    ``props`` is canonical text. A replace keeps the edge id; of several equal existing relations the smallest id counts.
    """
    e = existing.groupBy("src", "dst", "role").agg(F.min(F.struct("edge_id", "props")).alias("__e"))
    x = candidates.join(e, ["src", "dst", "role"], "left")
    action = F.when(F.col("__e").isNull(), "insert").when(F.col("__e.props") == F.col("props"), "skip").otherwise("replace")
    return x.select("src", "dst", "role", "props", action.alias("action"), F.col("__e.edge_id").alias("edge_id"))


def bulk_insert(requests: DataFrame, nodes: DataFrame, parent_kinds: Sequence[str], target_kinds: Sequence[str] | None = None,
                edge_type: str = "references") -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, new_id, kind, parent_id[, target_id]) to change rows, with reference checks.

    Returns (ops, rejects). Each accepted request gives node.add, edge.add (contains) and, with ``target_kinds``, a
    second edge.add of ``edge_type`` to its target.
    """
    n = nodes.select("id", "kind")
    x = requests.join(n.select(F.col("id").alias("parent_id"), F.col("kind").alias("__pk")), "parent_id", "left")
    reason = F.when(F.col("__pk").isNull(), "unknown-parent").when(~F.col("__pk").isin(*parent_kinds), "parent-kind")
    if target_kinds is not None:
        x = x.join(n.select(F.col("id").alias("target_id"), F.col("kind").alias("__tk")), "target_id", "left")
        reason = reason.when(F.col("__tk").isNull(), "unknown-target").when(~F.col("__tk").isin(*target_kinds), "target-kind")
    clash = n.select(F.col("id").alias("new_id"), F.lit(True).alias("__taken"))
    x = x.join(clash, "new_id", "left").withColumn("reason", reason.when(F.col("__taken"), "id-taken"))
    row = lambda i, op, a, b, t: F.struct(F.lit(i).alias("op_idx"), F.lit(op).alias("op_type"), a.alias("src"), b.alias("dst"), t.alias("type"))
    none = F.lit(None).cast("string")
    parts = [row(0, "node.add", F.col("new_id"), none, F.col("kind")), row(1, "edge.add", F.col("parent_id"), F.col("new_id"), F.lit("contains"))]
    if target_kinds is not None:
        parts.append(row(2, "edge.add", F.col("new_id"), F.col("target_id"), F.lit(edge_type)))
    ops = x.where("reason is null").select("request_id", F.explode(F.array(*parts)).alias("o")).select("request_id", "o.*")
    return ops, x.where("reason is not null").select("request_id", "reason")


def detection_violations(objects: DataFrame, relations: DataFrame, nodes: DataFrame, max_objects: int = 1024,
                         max_relations: int | None = 4096) -> DataFrame:
    """(batch_id, item, code): field, target and size rules of detection batches; ``None`` states no limit on relations.

    Objects: batch_id, object_id, name, object_type, semantic_id; relations: batch_id, object_id, role, target_id, target_semantic_id.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    codes = F.array_compact(F.array(F.when(blank("object_type"), F.lit("type-required")),
                                    F.when(blank("name") & blank("object_type"), F.lit("name-required")),
                                    F.when(F.col("semantic_id").isNotNull() & (F.trim("semantic_id") == ""), F.lit("semantic-id-blank"))))
    rows = objects.select("batch_id", F.col("object_id").cast("string").alias("item"), F.explode(codes).alias("code"))
    r = relations.join(nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("__known")), "target_id", "left").join(
        objects.where("semantic_id is not null").select("batch_id", F.col("semantic_id").alias("target_semantic_id"), F.lit(True).alias("__sem")).distinct(),
        ["batch_id", "target_semantic_id"], "left")
    code = (F.when(blank("role"), "role-required").when(F.col("target_id").isNotNull(), F.when(F.col("__known").isNull(), F.lit("unknown-target")))
            .when(F.col("target_semantic_id").isNotNull(), F.when(F.col("__sem").isNull(), F.lit("unknown-semantic-target")))
            .otherwise("target-required"))
    rel = r.select("batch_id", F.col("object_id").cast("string").alias("item"), code.alias("code")).where("code is not null")
    many_o = objects.groupBy("batch_id").count().where(F.col("count") > max_objects).select("batch_id", F.lit("*").alias("item"), F.lit("too-many-objects").alias("code"))
    found = rows.unionByName(rel).unionByName(many_o)
    if max_relations is None:
        return found
    many_r = relations.groupBy("batch_id").count().where(F.col("count") > max_relations).select("batch_id", F.lit("*").alias("item"), F.lit("too-many-relations").alias("code"))
    return found.unionByName(many_r)
