"""Job ledgers and task dependency tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import canonical_json, fnv32
from ..session import durable
from .evaluation import explode_range, proxy_size
from .fold import chain_marks, machine_scan
from .scan import asof, span_of, span_scan

OPS_STATES = ("pending", "running", "complete", "failed")


def job_plan(ranges: DataFrame, chunk_frames: int = 120) -> DataFrame:
    """Ranges (signature, fps, range_start, range_end) to fixed chunks with ids, frames and times."""
    fps = F.col("fps")
    first, end = F.ceil(F.col("range_start") * fps - 1e-9).cast("bigint"), F.ceil(F.col("range_end") * fps - 1e-9).cast("bigint")
    x = ranges.where(fps > 0).withColumn("__a", first).withColumn("__b", end)
    x = explode_range(x, F.lit(0), F.ceil((F.col("__b") - F.col("__a")) / chunk_frames), "index")
    a = F.col("__a") + F.col("index") * chunk_frames
    b = F.least(F.col("__b"), a + chunk_frames)
    return x.select("signature", "index", F.concat(F.col("signature").cast("string"), F.lit(":"), F.lpad(F.col("index").cast("string"), 5, "0")).alias("chunk_id"),
                    a.alias("frame_start"), b.alias("frame_end"), (b - a).alias("frame_count"), (a / fps).alias("time_start"), (b / fps).alias("time_end"))


def keyframe_segments(keyframes: DataFrame, totals: DataFrame, target: float = 8.0, span_width: float = 1e6) -> DataFrame:
    """(asset_id, index, start, end): cut at the first keyframe at or after each target, or at the target itself at the end.

    Only keyframes can move a cut: each one points at the keyframe that would follow it as a cut, an as-of join, and the cuts are the chain of
    pointers from the beginning. The tail after the last cut is plain arithmetic. Pick ``span_width`` so that the busiest asset has about 1e5
    keyframes in it.
    """
    target = max(0.25, target)
    k = keyframes.join(totals, "asset_id").where((F.col("time") > 0) & (F.col("time") < F.col("total"))).select(
        "asset_id", F.col("time").cast("double").alias("time")).distinct()
    nodes = durable(k.unionByName(totals.where("total > 0").select("asset_id", F.lit(0.0).alias("time"))))
    probes = nodes.withColumn("__want", F.col("time") + target - 0.001)
    follow = asof(k, probes, ["asset_id"], "time", "__want", [], "time", span_width).select("asset_id", "time", F.col("right.time").alias("__succ"))
    cuts = durable(chain_marks(follow, ["asset_id"], "time", "__succ", lambda c: span_of(c, span_width)).where("time > 0").select(
        "asset_id", F.col("time").alias("start")))
    last = cuts.groupBy("asset_id").agg(F.max("start").alias("__l"))
    t = totals.where("total > 0").join(last, "asset_id", "left").withColumn("__l", F.coalesce("__l", F.lit(0.0)))
    # fixed steps strictly before the end, from the last keyframe cut on
    steps = F.ceil((F.col("total") - F.col("__l")) / target).cast("bigint") - 1
    tail = explode_range(t.withColumn("__n", F.greatest(F.lit(0), steps)), F.lit(1), F.col("__n") + 1, "__i").select(
        "asset_id", (F.col("__l") + F.col("__i") * target).alias("start"))
    heads = totals.where("total > 0").select("asset_id", F.lit(0.0).alias("start"))
    starts = heads.unionByName(cuts).unionByName(tail)
    x = span_scan(starts, ["asset_id"], ["start"], span_of("start", 1e6), __next=("lead", F.col("start")), index=("row_number",))
    return x.join(totals, "asset_id").select("asset_id", (F.col("index") - 1).alias("index"), "start", F.coalesce("__next", F.col("total")).alias("end"))


def derivative_plan(sources: DataFrame, proxy_edge: float = 1280, thumbnails: int = 12) -> DataFrame:
    """Derivatives each source needs: (asset_id, type, width, height, times)."""
    kind, edge = F.col("asset_kind"), F.greatest(F.coalesce("width", F.lit(0.0)), F.coalesce("height", F.lit(0.0)))
    pw, ph = proxy_size(F.col("width"), F.col("height"), proxy_edge)
    item = lambda t, w, h, n: F.struct(F.lit(t).alias("type"), w.cast("bigint").alias("width"), h.cast("bigint").alias("height"), n.alias("times"))
    none = F.lit(None).cast("bigint")
    times = F.when(kind == "video", F.when(F.coalesce("duration", F.lit(0.0)) > 0, thumbnails).otherwise(0)).otherwise(1).cast("bigint")
    items = F.array_compact(F.array(
        F.when(kind.isin("video", "image", "vector"), item("thumbnail", F.lit(320), none, times)),
        F.when((kind == "video") & (edge > proxy_edge), item("proxy-video", pw, ph, none)),
        F.when(kind.isin("audio", "music", "video"), item("waveform", F.lit(1024), none, none))))
    return sources.select("asset_id", F.explode(items).alias("d")).select("asset_id", "d.*")


def thumbnail_times(sources: DataFrame, count: int = 12) -> DataFrame:
    """Evenly spaced times from start to end of each source."""
    d = F.greatest(F.lit(0.0), F.coalesce("duration", F.lit(0.0)))
    x = sources.withColumn("__d", d).where(F.col("__d") > 0)
    if count == 1:
        return x.select("asset_id", F.lit(0).cast("bigint").alias("slot"), (F.col("__d") / 2).alias("time"))
    return explode_range(x, F.lit(0), F.lit(count), "slot").select("asset_id", "slot", (F.col("__d") * F.col("slot") / (count - 1)).alias("time"))


def derivative_key(asset: Column, kind: Column, spec_json: Column) -> Column:
    return F.concat(F.lit("derived:"), asset.cast("string"), F.lit(":"), kind, F.lit(":"), fnv32(canonical_json(spec_json)))


# --- status -------------------------------------------------------------------------------------------------------------

def job_status(chunks: DataFrame) -> DataFrame:
    """complete when all are, failed when one is out of attempts, running when any runs, else pending."""
    s = F.col("status")
    g = chunks.groupBy("job_id").agg(F.bool_and(s == "complete").alias("done"), F.bool_or(s == "running").alias("running"),
                                     F.bool_or((s == "failed") & (F.col("attempts") >= F.col("max_attempts"))).alias("dead"))
    return g.select("job_id", F.when(F.col("done"), "complete").when(F.col("dead"), "failed").when(F.col("running"), "running").otherwise("pending").alias("status"))


def job_progress(chunks: DataFrame) -> DataFrame:
    s = lambda st: F.sum(F.when(F.col("status") == st, F.col("frame_count")).otherwise(0))
    g = chunks.groupBy("job_id").agg(F.sum("frame_count").alias("total"), s("complete").alias("completed"), s("running").alias("running"), s("failed").alias("failed"),
                                     F.count("*").alias("segments"), F.count(F.when(F.col("status") == "complete", 1)).alias("completed_segments"))
    return g.withColumn("ratio", F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(F.lit(1.0)))


def recover(chunks: DataFrame) -> DataFrame:
    """Running chunks of an interrupted job: pending again, or failed when out of attempts."""
    running = F.col("status") == "running"
    status = F.when(running, F.when(F.col("attempts") < F.col("max_attempts"), "pending").otherwise("failed")).otherwise(F.col("status"))
    return chunks.withColumn("error", F.when(running, "Interrupted")).withColumn("status", status)


def replay_ledger(events: DataFrame, keys: list[str], order: list[str], span: Column, max_attempts: int = 3) -> DataFrame:
    """Add status, attempts and ``legal`` after each claim / complete / fail / release event of a chunk.

    A chunk is a finite machine (status x attempts), so long histories are cut into spans and stitched.
    """
    def step(state, values):
        status, attempts = state
        kind = values[0]
        if kind == "claim":
            if status == "pending" or (status == "failed" and attempts < max_attempts):
                state = ("running", min(attempts + 1, max_attempts))
                return state, (*state, True)
        elif status == "running":
            state = {"complete": ("complete", attempts), "fail": ("pending" if attempts < max_attempts else "failed", attempts),
                     "release": ("pending", max(0, attempts - 1))}.get(kind)
            if state:
                return state, (*state, True)
            state = (status, attempts)
        return state, (*state, False)

    states = [(s, a) for s in OPS_STATES for a in range(max_attempts + 1)]
    return machine_scan(events, keys, order, span, states, step, ["event"], "status string, attempts bigint, legal boolean")


def artifact_manifest(chunks: DataFrame) -> DataFrame:
    """Chunks of complete jobs (order by job_id, idx to read them back)."""
    done = job_status(chunks).where("status = 'complete'").select("job_id")
    return chunks.join(done, "job_id", "left_semi")


# --- dependencies ---------------------------------------------------------------------------------------------------------
# Tasks: task_id, status, optional. Deps: task_id, depends_on.

def production_tasks(chunks: DataFrame, sources: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, deps) of a render: verify sources, render each chunk, encode it, mux the job.

    Sources: job_id, source_id. Every frame task depends on the job's sources through one gate task per job, so deps grow
    with sources + chunks instead of their product.
    """
    job = F.col("job_id").cast("string")
    src = sources.select(F.concat_ws(":", F.lit("source"), job, "source_id").alias("task_id"), F.lit("verify-source").alias("kind"), "job_id").distinct()
    gate = jobs.select(F.concat(F.lit("sources:"), job).alias("task_id"), F.lit("sources-ready").alias("kind"), "job_id")
    cid = F.col("chunk_id")
    frames = chunks.select(F.concat(F.lit("frames:"), cid).alias("task_id"), F.lit("render-frames").alias("kind"), "job_id")
    encode = chunks.select(F.concat(F.lit("encode:"), cid).alias("task_id"), F.lit("encode-video").alias("kind"), "job_id")
    mux = jobs.select(F.concat(F.lit("mux:"), job).alias("task_id"), F.lit("mux").alias("kind"), "job_id")
    tasks = src.unionByName(gate).unionByName(frames).unionByName(encode).unionByName(mux)
    deps = (src.select(F.concat(F.lit("sources:"), job).alias("task_id"), F.col("task_id").alias("depends_on"))
            .unionByName(frames.select("task_id", F.concat(F.lit("sources:"), job).alias("depends_on")))
            .unionByName(chunks.select(F.concat(F.lit("encode:"), cid).alias("task_id"), F.concat(F.lit("frames:"), cid).alias("depends_on")))
            .unionByName(chunks.select(F.concat(F.lit("mux:"), job).alias("task_id"), F.concat(F.lit("encode:"), cid).alias("depends_on"))))
    return tasks, deps


def dependency_violations(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task_id, code): repeated ids, unknown dependencies, members of or behind a cycle."""
    dup = tasks.groupBy("task_id").count().where("count > 1").select("task_id", F.lit("duplicate").alias("code"))
    unknown = deps.join(tasks.select(F.col("task_id").alias("depends_on")), "depends_on", "left_anti").select("task_id", F.lit("unknown-dependency").alias("code")).distinct()
    stuck = tasks.select("task_id").distinct().join(task_levels(tasks, deps).select("task_id"), "task_id", "left_anti").select("task_id", F.lit("cycle").alias("code"))
    return dup.unionByName(unknown).unionByName(stuck)


def task_levels(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task_id, level): wave in which a task becomes ready; order by (level, task_id) is the execution order.

    One wave per iteration, materialised each time. Tasks in or behind a cycle never become ready and are left out.
    Dependencies on tasks that do not exist are ignored here.
    """
    ids = tasks.select("task_id").distinct()
    d = durable(deps.join(ids.select(F.col("task_id").alias("depends_on")), "depends_on", "left_semi").distinct())
    need = durable(ids.join(d.groupBy("task_id").agg(F.count("*").alias("open")), "task_id", "left").withColumn("open", F.coalesce("open", F.lit(0))))
    out = None
    for level in count():
        ready = durable(need.where("open = 0").select("task_id", F.lit(level).cast("bigint").alias("level")))
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        freed = d.join(ready.select(F.col("task_id").alias("depends_on")), "depends_on").groupBy("task_id").agg(F.count("*").alias("n"))
        need = durable(need.where("open > 0").join(freed, "task_id", "left").select("task_id", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")))
    return out if out is not None else ids.where("false").withColumn("level", F.lit(0).cast("bigint"))


def runnable(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending tasks whose dependencies are all complete."""
    done = tasks.where("status = 'complete'").select(F.col("task_id").alias("depends_on"))
    blocked = deps.join(done, "depends_on", "left_anti").select("task_id").distinct()
    return tasks.where("status = 'pending'").join(blocked, "task_id", "left_anti")


def fail_cascade(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks after failures have reached every pending dependent: adds ``error`` to the tasks that fell."""
    state = durable(tasks.select("task_id", "status"))
    pending, front = state.where("status = 'pending'").select("task_id"), state.where("status = 'failed'").select("task_id")
    deps = durable(deps.select("task_id", "depends_on").join(pending, "task_id", "left_semi"))
    fallen = None
    while True:
        hit = deps.join(front.select(F.col("task_id").alias("depends_on")), "depends_on").select("task_id").distinct()
        if fallen is not None:
            hit = hit.join(fallen, "task_id", "left_anti")
        front = durable(hit)
        if front.isEmpty():
            break
        fallen = front if fallen is None else fallen.unionByName(front)
    if fallen is None:
        return tasks.withColumn("error", F.lit(None).cast("string"))
    x = tasks.join(fallen.withColumn("__f", F.lit(True)), "task_id", "left")
    return x.withColumn("status", F.when(F.col("__f"), "failed").otherwise(F.col("status"))).withColumn(
        "error", F.when(F.col("__f"), "dependency-failed")).drop("__f")


def task_progress(tasks: DataFrame, group: str) -> DataFrame:
    """Required and optional progress, done and blocked per group."""
    flag = lambda c: F.count(F.when(c, 1))
    req, s = ~F.col("optional"), F.col("status")
    g = tasks.groupBy(group).agg(
        flag(req).alias("required"), flag(req & (s == "complete")).alias("complete"), flag(req & (s == "failed")).alias("failed"),
        flag(s == "running").alias("running"), flag(F.col("optional")).alias("optional_total"),
        flag(F.col("optional") & s.isin("complete", "failed")).alias("optional_terminal"))
    return g.withColumn("ratio", F.when(F.col("required") > 0, F.col("complete") / F.col("required")).otherwise(F.lit(1.0))).withColumn(
        "done", (F.col("complete") == F.col("required")) & (F.col("optional_terminal") == F.col("optional_total"))).withColumn("blocked", F.col("failed") > 0)


def skip_failed_optional(tasks: DataFrame) -> DataFrame:
    skip = F.col("optional") & (F.col("status") == "failed")
    return tasks.withColumn("skipped", skip).withColumn("status", F.when(skip, "complete").otherwise(F.col("status")))


def merge_results(tasks: DataFrame, levels: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ops, missing): result operations in execution order, and tasks that owe a result.

    Results: task_id, op_no, op. Failed optional tasks are skipped. Order by (level, task_id, op_no).
    """
    wanted = tasks.where(~(F.col("optional") & (F.col("status") == "failed")))
    ops = results.join(wanted.select("task_id"), "task_id", "left_semi").join(levels, "task_id").select("level", "task_id", "op_no", "op")
    return ops, wanted.join(results.select("task_id").distinct(), "task_id", "left_anti").select("task_id")
