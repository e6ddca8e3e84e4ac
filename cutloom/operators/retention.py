"""Stored assets: usage, retention plans, caches and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .fold import ordered_fold
from .scan import span_scan

# Clean up from 90 % usage down to 80 %, rows older than 30 days.
PRESSURE_START, PRESSURE_TARGET, MIN_AGE_MS = 0.9, 0.8, 30 * 24 * 60 * 60 * 1000


def source_manifest(assets: DataFrame) -> DataFrame:
    """One typed row per asset: id, name, asset_kind, mime_type, size, hash, duration with the stated defaults."""
    d = {"asset_kind": "unknown", "mime_type": "", "size": 0}
    cols = [F.coalesce(F.col(c), F.lit(d[c])).alias(c) if c in d else F.col(c)
            for c in ("id", "name", "asset_kind", "mime_type", "size", "hash", "duration") if c in assets.columns]
    return assets.select(*cols)


# Container rules in order (container, content-type part, extensions).
CONTAINER_NAMES = (("mpegts", "mp2t", ("ts", "mts")), ("webm", "webm", ("webm",)), ("mov", "quicktime", ("mov",)),
                   ("mp4", "mp4", ("mp4", "m4v", "m4a", "m4s")), ("wav", "wav", ("wav",)), ("ogg", "ogg", ("ogg", "oga", "ogv")),
                   ("mp3", "mpeg", ("mp3",)))


def classify(mime: Column, name: Column, head: Column | None = None) -> Column:
    """Container by content type or extension, then by leading bytes (at least 12; a transport stream needs 188)."""
    m, ext = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    named = lambda rule: m.contains(rule[1]) | ext.isin(*rule[2])
    out = F.when(named(CONTAINER_NAMES[0]), CONTAINER_NAMES[0][0])
    if head is not None:
        h, n = F.hex(F.substring(head, 1, 189)), F.octet_length(head)
        out = out.when((n >= 188) & h.startswith("47") & ((n == 188) | (F.substring(h, 377, 2) == "47")), "mpegts")
    for rule in CONTAINER_NAMES[1:]:
        out = out.when(named(rule), rule[0])
    if head is not None:
        at = lambda first, count: F.substring(h, 2 * first + 1, 2 * count)
        long = n >= 12
        out = (out.when(long & (at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "wav")
               .when(long & at(4, 4).isin("66747970", "73747970", "6D6F6F66"), "mp4")
               .when(long & (at(0, 4) == "1A45DFA3"), "webm").when(long & (at(0, 4) == "4F676753"), "ogg"))
    return out.otherwise("unknown")


def blob_fingerprint(content: Column, size: Column, kind: Column, edge: int = 1 << 20) -> Column:
    """SHA-256 over ``size:type:``, the first and the last ``edge`` bytes (which overlap in small content)."""
    header = F.concat(size.cast("string"), F.lit(":"), F.coalesce(kind, F.lit("")), F.lit(":")).cast("binary")
    tail_start = F.greatest(F.lit(0), size - edge).cast("int") + 1
    return F.sha2(F.concat(header, F.substring(content, 1, edge), content.substr(tail_start, F.lit(edge))), 256)


def ends_fingerprint(head: Column, tail: Column, size: Column, kind: Column) -> Column:
    """The same of content whose first and last bytes were read apart."""
    header = F.concat(size.cast("string"), F.lit(":"), F.coalesce(kind, F.lit("")), F.lit(":")).cast("binary")
    return F.sha2(F.concat(header, head, tail), 256)


def verify_artifacts(declared: DataFrame, stored: DataFrame, max_bytes: int) -> DataFrame:
    """Declared (key, integrity) against stored (key, content): status per key.

    Integrity is 64 hex digits or ``sha256-`` plus base64; anything else is ``unsupported-integrity``.
    """
    x = declared.join(stored.select("key", "content"), "key", "left")
    text = F.trim("integrity")
    is_hex, is_sri = text.rlike("^[0-9a-fA-F]{64}$"), text.startswith("sha256-")
    want = F.when(is_hex, F.lower(text)).when(is_sri, F.lower(F.hex(F.unbase64(F.substring(text, 8, 200)))))
    status = (F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") > max_bytes, "too-large")
              .when(want.isNull(), "unsupported-integrity").when(F.sha2("content", 256) != want, "mismatch").otherwise("verified"))
    return x.select("key", F.octet_length("content").cast("bigint").alias("bytes"), status.alias("status"))


def list_by_prefix(artifacts: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    x = artifacts.where(F.col("key").startswith(prefix)).orderBy("key")
    return x if limit is None else x.limit(limit)


def without_prefix(artifacts: DataFrame, prefix: str) -> DataFrame:
    return artifacts.where(~F.col("key").startswith(prefix))


def duplicates_by_hash(assets: DataFrame) -> DataFrame:
    """Groups of equal content: hash, copies, first id, bytes that could be freed."""
    g = assets.groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("size").alias("size"))
    return g.where("copies > 1").withColumn("spare_bytes", (F.col("copies") - 1) * F.col("size"))


def usage(assets: DataFrame, quotas: DataFrame) -> DataFrame:
    """Usage, quota, free bytes and ratio per owner; a missing or zero quota gives no ratio."""
    u = assets.groupBy("owner").agg(F.sum("size").alias("usage"), F.count("*").alias("assets"))
    x = u.join(quotas, "owner", "left")
    return x.withColumn("available", F.greatest(F.lit(0), F.col("quota") - F.col("usage"))).withColumn(
        "ratio", F.when(F.col("quota") > 0, F.least(F.lit(1.0), F.col("usage") / F.col("quota"))))


def retention_references(*frames: DataFrame) -> DataFrame:
    """Distinct (project_id, id, hash) references of the live graph and its history snapshots."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["project_id", "id", "hash"])


def retention_reasons(assets: DataFrame, referenced_ids: DataFrame, referenced_hashes: DataFrame, now: int, min_age: int) -> DataFrame:
    """Add ``reason`` for keeping: referenced-id, referenced-hash, unknown-age, recent; null marks a candidate."""
    i = referenced_ids.select("id").distinct().withColumn("__i", F.lit(True))
    h = referenced_hashes.select("hash").where("hash is not null").distinct().withColumn("__h", F.lit(True))
    x = assets.join(i, "id", "left").join(h, "hash", "left")
    reason = (F.when(F.col("__i"), "referenced-id").when(F.col("__h"), "referenced-hash").when(F.col("saved_at").isNull(), "unknown-age")
              .when(F.lit(now) - F.col("saved_at") < min_age, "recent"))
    return x.withColumn("reason", reason).drop("__i", "__h")


def within_budget(rows: DataFrame, budgets: DataFrame, owner: str, order: Sequence[str], size: str, span: Column,
                  rounds: int = 3) -> DataFrame:
    """Add ``taken``: in order, a row is taken when it still fits the owner's budget (owner, budget); others are skipped.

    Not a prefix sum: later smaller rows may fit after a skip. Each round takes, by running sums over spans, everything
    up to the first row that does not fit, then drops all rows larger than what is left. The few rows that survive the
    rounds go through an ordered fold that starts from the remaining budget.
    """
    order = list(order)
    keep = [owner, *order, size]
    base = rows.join(budgets, owner).withColumn("__left", F.col("budget"))
    live = base.where(F.col(size) <= F.col("__left")).select(*keep, "__left")
    taken = []
    for _ in range(rounds):
        x = span_scan(live, [owner], order, span, __run=("sum", F.col(size)))
        over = x.where(F.col("__run") > F.col("__left")).groupBy(owner).agg(F.min(F.struct(*order)).alias("__stop"))
        x = durable(x.join(over, owner, "left").withColumn("__fit", F.col("__stop").isNull() | (F.struct(*order) < F.col("__stop"))))
        taken.append(x.where("__fit").select(*keep))
        spent = x.where("__fit").groupBy(owner).agg(F.sum(size).alias("__spent"))
        live = x.where(~F.col("__fit") & (F.struct(*order) > F.col("__stop"))).join(spent, owner, "left").withColumn(
            "__left", F.col("__left") - F.coalesce("__spent", F.lit(0))).where(F.col(size) <= F.col("__left")).select(*keep, "__left")

    def step(state, values):
        n, left = values
        left = left if state is None else state
        ok = n <= left
        return (left - n if ok else left), (bool(ok),)

    rest = ordered_fold(live, [owner], order, lambda: None, step, [size, "__left"], "ok boolean")
    taken.append(rest.where("ok").select(*keep))
    all_taken = taken[0]
    for part in taken[1:]:
        all_taken = all_taken.unionByName(part)
    marks = all_taken.select(owner, *order).withColumn("taken", F.lit(True))
    return rows.join(marks, [owner, *order], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def pressure_budgets(usages: DataFrame) -> DataFrame:
    """(owner, budget): bytes to delete for owners at or above the pressure mark."""
    hot = usages.where(F.col("ratio") >= PRESSURE_START)
    return hot.select("owner", F.ceil(F.col("usage") - F.col("quota") * PRESSURE_TARGET).cast("bigint").alias("budget"))


# --- caches -------------------------------------------------------------------------------------------------------------

def frame_key(asset: Column, time: Column, fps: int, width: Column, height: Column, variant: str = "preview") -> Column:
    """Key of a decoded frame: the time is quantised to a frame number."""
    whole = lambda c: F.greatest(F.lit(0), F.round(F.coalesce(c, F.lit(0.0))).cast("bigint")).cast("string")
    frame = F.greatest(F.lit(0), F.round(F.coalesce(time, F.lit(0.0)) * fps).cast("bigint")).cast("string")
    return F.concat(F.lit(f"{variant}:"), asset.cast("string"), F.lit(":f"), frame, F.lit(f"@{fps}:"), whole(width), F.lit("x"), whole(height))


def source_key(asset: Column, content_hash: Column, size: Column, mime: Column) -> Column:
    return F.concat(F.lit("source:"), F.coalesce(F.nullif(content_hash, F.lit("")), asset.cast("string")), F.lit(":"),
                    F.coalesce(size, F.lit(0)).cast("string"), F.lit(":"), F.coalesce(mime, F.lit("")))


def prune_states(artifacts: DataFrame, current: DataFrame) -> DataFrame:
    """Artifacts (key, schema, project_id, kinds, fingerprint) against the current fingerprint of their scope.

    Same scope and fingerprint: retain; same scope, other fingerprint: remove; no current scope: other.
    """
    c = current.select("schema", "project_id", "kinds", F.col("fingerprint").alias("__now"))
    x = artifacts.join(c, ["schema", "project_id", "kinds"], "left")
    state = F.when(F.col("__now").isNull(), "other").when(F.col("fingerprint") == F.col("__now"), "retain").otherwise("remove")
    return x.withColumn("state", state).drop("__now")


def missing_keys(wanted: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """What an incremental build still has to make."""
    return wanted.join(existing.select(key).distinct(), key, "left_anti")


def first_valid(wanted: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best valid hit per wanted key by backend preference, and invalid entries to drop.

    Cached: key, preference, valid, value.
    """
    hits = cached.where("valid").groupBy("key").agg(F.min_by("value", "preference").alias("value"), F.min("preference").alias("preference"))
    return wanted.join(hits, "key", "left"), cached.where("not valid").select("key", "preference")
