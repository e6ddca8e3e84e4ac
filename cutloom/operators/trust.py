"""Trust tables: key validity, replay detection, freshness, retention, revocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

DAY_MS = 24 * 60 * 60 * 1000


def resolve_keys(messages: DataFrame, actors: DataFrame, keys: DataFrame) -> DataFrame:
    """Messages (.., actor_id, key_id, purpose, at) with ``reason``: null when the key was valid at that time.

    Actors: actor_id, status; keys: actor_id, key_id, status, purposes, not_before, expires_at.
    """
    a = actors.select("actor_id", F.col("status").alias("__as"))
    k = keys.select("actor_id", "key_id", F.col("status").alias("__ks"), "purposes", "not_before", "expires_at")
    x = messages.join(a, "actor_id", "left").join(k, ["actor_id", "key_id"], "left")
    scoped = F.array_contains("purposes", F.col("purpose")) | F.array_contains("purposes", "*")
    reason = (F.when(F.col("__as").isNull(), "unknown-actor").when(F.col("__as") != "active", "actor-revoked")
              .when(F.col("__ks").isNull(), "unknown-key").when(F.col("__ks") != "active", "key-revoked")
              .when(~scoped, "purpose").when(F.col("at") < F.col("not_before"), "not-yet-valid")
              .when(F.col("at") >= F.col("expires_at"), "expired"))
    return x.select(*messages.columns, reason.alias("reason"))


def replays(messages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Add ``replayed``: true for every use of a nonce after its first.

    Only the first use per nonce is aggregated (map-side), so a flooded nonce costs one row per task.
    """
    first = messages.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"))
    x = messages.join(first, key)
    return x.withColumn("replayed", F.struct(*order) != F.col("__first")).drop("__first")


def freshness(messages: DataFrame, now: int, max_age: int | None, skew: int = 0) -> DataFrame:
    age = F.lit(now) - F.col("at")
    if max_age is None:
        return messages.withColumn("reason", F.lit(None).cast("string"))
    reason = F.when(F.col("at").isNull(), "issued-at-required").when(age > max_age, "too-old").when(age < -max(0, skew), "in-future")
    return messages.withColumn("reason", reason)


def retain_nonces(nonces: DataFrame, now: int, retention: int = DAY_MS, max_entries: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """Nonces inside the age window; on request only the latest ``max_entries`` of each registry (``scope``), ties by nonce.

    A nonce that is dropped can be replayed, so nothing is dropped unless asked for.
    """
    fresh = nonces if not retention else nonces.where(F.col("consumed_at").isNull() | (F.lit(now) - F.col("consumed_at") <= retention))
    if max_entries is None:
        return fresh
    w = W.partitionBy(*(scope or [])).orderBy(F.coalesce("consumed_at", F.lit(0)).desc(), "nonce")
    if not scope:
        return fresh.orderBy(F.coalesce("consumed_at", F.lit(0)).desc(), "nonce").limit(max(1, max_entries))
    return fresh.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(1, max_entries)).drop("__rn")


def revoke(actors: DataFrame, keys: DataFrame, revoked_actors: DataFrame, revoked_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply revocations (actor_id[, key_id], revoked_at): an actor's revocation reaches all of its active keys.

    Rows that are already revoked keep their time.
    """
    ra = revoked_actors.groupBy("actor_id").agg(F.min("revoked_at").alias("__ra"))
    rk = revoked_keys.groupBy("actor_id", "key_id").agg(F.min("revoked_at").alias("__rk"))

    def apply(df, mark):
        hit = (F.col("status") == "active") & mark.isNotNull()
        return df.withColumn("revoked_at", F.when(hit, mark).otherwise(F.col("revoked_at"))).withColumn(
            "status", F.when(hit, "revoked").otherwise(F.col("status")))

    a = apply(actors.join(ra, "actor_id", "left"), F.col("__ra")).drop("__ra")
    k = keys.join(ra, "actor_id", "left").join(rk, ["actor_id", "key_id"], "left")
    return a, apply(k, F.least("__ra", "__rk")).drop("__ra", "__rk")


def enrolment_violations(actors: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, code): repeated actors or keys, keys of unknown actors, empty validity windows."""
    dup_a = actors.groupBy("actor_id").count().where("count > 1").select(F.col("actor_id").cast("string").alias("id"), F.lit("actor-exists").alias("code"))
    kid = F.concat_ws("/", "actor_id", "key_id")
    dup_k = keys.groupBy("actor_id", "key_id").count().where("count > 1").select(kid.alias("id"), F.lit("key-exists").alias("code"))
    lost = keys.join(actors.select("actor_id"), "actor_id", "left_anti").select(kid.alias("id"), F.lit("unknown-actor").alias("code"))
    window = keys.where(F.col("expires_at") <= F.col("not_before")).select(kid.alias("id"), F.lit("empty-window").alias("code"))
    return dup_a.unionByName(dup_k).unionByName(lost).unionByName(window)
