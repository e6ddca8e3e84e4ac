"""Conflict analysis between concurrent operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def resources(ops: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Ops (keys.., seq, op_idx, op_type, entity_id, other_id, prop, edge_id) to the things they touch: scope, id, path."""
    r = lambda scope, i, path: F.struct(F.lit(scope).alias("scope"), i.cast("string").alias("id"), path.alias("path"))
    star, links = F.lit("*"), F.lit("@links")
    node, update = r("node", F.col("entity_id"), star), r("node", F.col("entity_id"), F.concat(F.lit("props:"), "prop"))
    edge = F.array(r("edge", F.col("edge_id"), star), r("node", F.col("entity_id"), links), r("node", F.col("other_id"), links))
    touch = r("node", F.col("entity_id"), F.lit("@touch"))
    t = F.col("op_type")
    items = (F.when(t.isin("node.add", "node.remove"), F.array(node))
             .when(t == "node.update", F.array(F.when(F.col("prop").isNull(), touch).otherwise(update)))
             .when(t == "edge.add", edge).when(t == "edge.remove", F.array(r("edge", F.col("edge_id"), star)))
             .otherwise(F.array(r("global", star, star))))
    return ops.select(*keys, "seq", "op_idx", F.explode(items).alias("r")).select(*keys, "seq", "op_idx", "r.*")


def _sides(local: DataFrame, remote: DataFrame, keep: Sequence[str]):
    l = resources(local, keep).select(*keep, *[F.col(c).alias(f"l_{c}") for c in ("seq", "op_idx")], "scope", "id", F.col("path").alias("l_path"))
    r = resources(remote, keep).select(*keep, *[F.col(c).alias(f"r_{c}") for c in ("seq", "op_idx")], "scope", "id", F.col("path").alias("r_path"))
    return l, r


def conflict_pairs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(project_id, l_seq, l_op_idx, r_seq, r_op_idx): every conflicting pair of operations once.

    Equi joins on (project, scope, id, path) for equal paths and on (project, scope, id) for whole-entity rows only;
    global operations meet everything of their project. For verdicts use ``conflict_counts``, which forms no pairs.
    """
    l, r = _sides(local, remote, ("project_id",))
    coords = ["project_id", "l_seq", "l_op_idx", "r_seq", "r_op_idx"]
    named, star = F.col("l_path") != "*", F.col("r_path") != "*"
    same = l.where(named & (F.col("scope") != "global")).withColumn("path", F.col("l_path")).join(
        r.where(star).withColumn("path", F.col("r_path")), ["project_id", "scope", "id", "path"])
    l_all = l.where(~named & (F.col("scope") != "global")).join(r.where(F.col("scope") != "global"), ["project_id", "scope", "id"])
    r_all = l.where(named & (F.col("scope") != "global")).join(r.where(~star & (F.col("scope") != "global")), ["project_id", "scope", "id"])
    g_l = l.where(F.col("scope") == "global").select("project_id", "l_seq", "l_op_idx").join(
        r.select("project_id", "r_seq", "r_op_idx").distinct(), "project_id")
    g_r = l.where(F.col("scope") != "global").select("project_id", "l_seq", "l_op_idx").distinct().join(
        r.where(F.col("scope") == "global").select("project_id", "r_seq", "r_op_idx"), "project_id")
    out = same.select(*coords)
    for part in (l_all, r_all, g_l, g_r):
        out = out.unionByName(part.select(*coords))
    return out.distinct()


def conflict_counts(local: DataFrame, remote: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """(keys.., r_seq, r_op_idx, hits): resource hits of each remote operation, from counts alone.

    Local resources are folded to counts per path before the join, so a hot entity costs one row per path.
    """
    l, r = _sides(local, remote, keys)
    paths = l.groupBy(*keys, "scope", "id", F.col("l_path").alias("path")).agg(F.count("*").alias("n"))
    whole = paths.groupBy(*keys, "scope", "id").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("path") == "*", F.col("n")).otherwise(0)).alias("n_star"))
    glob = l.where("scope = 'global'").groupBy(*keys).agg(F.count("*").alias("n_global"))
    size = l.groupBy(*keys).agg(F.count("*").alias("n_local"))
    x = r.withColumn("path", F.col("r_path")).join(paths.withColumnRenamed("n", "n_path"), [*keys, "scope", "id", "path"], "left")
    x = x.join(whole, [*keys, "scope", "id"], "left").join(glob, [*keys], "left").join(size, [*keys], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    hits = F.when(F.col("scope") == "global", z("n_local")).when(F.col("path") == "*", z("n_all") + z("n_global")).otherwise(
        z("n_path") + z("n_star") + z("n_global"))
    return x.groupBy(*keys, "r_seq", "r_op_idx").agg(F.sum(hits).cast("bigint").alias("hits"))


def rebase_status(batches: DataFrame, log: DataFrame, remote_ops: DataFrame) -> DataFrame:
    """Batches (batch_id, project_id, base_revision, log_revision, fork_seq, fork_tx) classified.

    different-base, different-history, current, rebase-safe or conflict, in that order; only log entries after a batch's own
    fork, and only its own operations (batch_id in ``remote_ops``), can conflict.
    """
    head = log.groupBy("project_id").agg(F.max("seq").alias("head_seq"))
    at = log.select("project_id", F.col("seq").alias("fork_seq"), F.col("tx_id").alias("__at_tx"))
    b = batches.join(head, "project_id", "left").join(at, ["project_id", "fork_seq"], "left")
    after = log.join(batches.select("batch_id", "project_id", "fork_seq"), "project_id").where(F.col("seq") > F.col("fork_seq")).drop("fork_seq")
    hits = conflict_counts(after, remote_ops, ["batch_id"]).groupBy("batch_id").agg(F.sum("hits").alias("hits"))
    x = b.join(hits, "batch_id", "left")
    known = F.when(F.col("fork_seq") == 0, F.col("fork_tx").isNull()).otherwise(F.col("__at_tx").eqNullSafe(F.col("fork_tx")) & F.col("__at_tx").isNotNull())
    status = (F.when(F.col("head_seq").isNull() | (F.col("base_revision") != F.col("log_revision")), "different-base")
              .when(~known, "different-history").when(F.col("fork_seq") == F.col("head_seq"), "current")
              .when(F.coalesce("hits", F.lit(0)) > 0, "conflict").otherwise("rebase-safe"))
    return x.select("batch_id", "project_id", status.alias("status"))


def plan_rebase(plans: DataFrame, plan_ops: DataFrame, log: DataFrame, current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Plans (plan_id, project_id, base_seq) against the log entries after their base; ``plan_ops`` carry their plan_id.

    ``reconstruction-failed`` when replaying does not give the current fingerprint.
    """
    after = log.join(plans.select("plan_id", "project_id", "base_seq"), "project_id").where(F.col("seq") > F.col("base_seq")).drop("base_seq")
    hits = conflict_counts(after, plan_ops, ["plan_id"]).groupBy("plan_id").agg(F.sum("hits").alias("hits"))
    f = current.select("project_id", F.col("fingerprint").alias("__now")).join(
        rebuilt.select("project_id", F.col("fingerprint").alias("__again")), "project_id", "full")
    x = plans.join(hits, "plan_id", "left").join(f, "project_id", "left")
    status = F.when(~F.col("__now").eqNullSafe(F.col("__again")), "reconstruction-failed").when(
        F.coalesce("hits", F.lit(0)) > 0, "conflict").otherwise("rebase-safe")
    return x.select("plan_id", "project_id", status.alias("status"))


def conflict_model(pairs: DataFrame, local: DataFrame, remote: DataFrame, names: DataFrame) -> DataFrame:
    """Conflict rows for people: id, labels of both operations and the path label."""
    def side(ops, p):
        n = names.select("entity_id", F.col("name").alias("__name"))
        who = F.coalesce("__name", F.col("entity_id").cast("string"))
        verb = (F.when(F.col("op_type") == "node.add", F.concat(F.lit("Add node "), who)).when(F.col("op_type") == "node.remove", F.concat(F.lit("Remove node "), who))
                .when(F.col("op_type") == "node.update", F.concat(F.lit("Update "), who, F.lit(" · props:"), "prop"))
                .when(F.col("op_type") == "edge.add", F.concat(F.lit("Add edge "), F.col("edge_id").cast("string")))
                .when(F.col("op_type") == "edge.remove", F.concat(F.lit("Remove edge "), F.col("edge_id").cast("string")))
                .otherwise(F.concat(F.lit("Unknown operation "), "op_type")))
        return ops.join(n, "entity_id", "left").select("project_id", F.col("seq").alias(f"{p}_seq"), F.col("op_idx").alias(f"{p}_op_idx"), verb.alias(f"{p}_summary"))

    x = pairs.dropDuplicates(["project_id", "l_seq", "l_op_idx", "r_seq", "r_op_idx"])
    x = x.join(side(local, "l"), ["project_id", "l_seq", "l_op_idx"]).join(side(remote, "r"), ["project_id", "r_seq", "r_op_idx"])
    return x.withColumn("row_id", F.concat(F.col("l_seq"), F.lit(":"), F.col("l_op_idx"), F.lit("|"), F.col("r_seq"), F.lit(":"), F.col("r_op_idx")))


def decision_groups(model: DataFrame) -> DataFrame:
    """One group per remote operation: number of rows, first row id and an order-free fingerprint of its row ids."""
    h = F.conv(F.substring(F.sha2("row_id", 256), 1, 15), 16, 10).cast("bigint")
    return model.select("project_id", "r_seq", "r_op_idx", "row_id").distinct().groupBy("project_id", "r_seq", "r_op_idx").agg(
        F.count("*").alias("rows"), F.min("row_id").alias("first_row"), F.lower(F.hex(F.bit_xor(h))).alias("fingerprint"))


def decision_progress(groups: DataFrame, decisions: DataFrame, complete: DataFrame) -> DataFrame:
    """Per project: decided, total, remaining, ratio, ready. Decisions: project_id, r_seq, r_op_idx, choice."""
    d = decisions.where(F.col("choice").isin("keep-local", "reapply-remote", "manual"))
    x = groups.join(d.select("project_id", "r_seq", "r_op_idx", "choice"), ["project_id", "r_seq", "r_op_idx"], "left")
    p = x.groupBy("project_id").agg(F.count("choice").alias("decided"), F.count("*").alias("total")).join(complete, "project_id", "left")
    return p.select("project_id", "decided", "total", (F.col("total") - F.col("decided")).alias("remaining"),
                    F.when(F.col("total") > 0, F.col("decided") / F.col("total")).otherwise(F.lit(1.0)).alias("ratio"),
                    (F.coalesce("complete", F.lit(False)) & (F.col("decided") == F.col("total"))).alias("ready"))


def resolution_violations(groups: DataFrame, decisions: DataFrame, replacements: DataFrame, log: DataFrame, complete: DataFrame) -> DataFrame:
    """(project_id, group_id, code): why a resolution cannot be finalised.

    Replacements: project_id, r_seq, r_op_idx, tx_id. A keep-local group has none, any other needs at least one; ids must
    be new to the log and used once.
    """
    key = ["project_id", "r_seq", "r_op_idx"]
    gid = F.concat_ws(":", "r_seq", "r_op_idx")
    n = replacements.groupBy(*key).agg(F.count("*").alias("__n"))
    x = groups.join(decisions.select(*key, "choice"), key, "left").join(n, key, "left").join(complete, "project_id", "left")
    count = F.coalesce("__n", F.lit(0))
    codes = F.array_compact(F.array(
        F.when(~F.coalesce("complete", F.lit(False)), F.lit("incomplete")), F.when(F.col("choice").isNull(), F.lit("undecided")),
        F.when((F.col("choice") == "keep-local") & (count > 0), F.lit("keep-local-with-replacement")),
        F.when((F.col("choice") != "keep-local") & (count == 0), F.lit("missing-replacement"))))
    out = x.select("project_id", gid.alias("group_id"), F.explode(codes).alias("code"))
    unknown = replacements.join(groups, key, "left_anti").select("project_id", gid.alias("group_id"), F.lit("unknown-group").alias("code"))
    reused = replacements.join(log.select("project_id", "tx_id"), ["project_id", "tx_id"], "left_semi").select(
        "project_id", gid.alias("group_id"), F.lit("transaction-reused").alias("code"))
    twice = replacements.groupBy("project_id", "tx_id").agg(F.count("*").alias("__n"), F.max(gid).alias("group_id")).where("__n > 1").select(
        "project_id", "group_id", F.lit("transaction-repeated").alias("code"))
    return out.unionByName(unknown).unionByName(reused).unionByName(twice)
