"""Data-quality rules as rows: (id, code). One scan per kind evaluates all of its rules."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

EPS = 0.001  # fixed value
# Node kinds and edge types.
NODE_KINDS = ("project", "asset", "composition", "track", "clip", "layer", "effect", "output", "object")
EDGE_TYPES = ("contains", "references", "derives-from", "synchronizes", "targets", "relates-to")
MAX_DEPTH, MAX_ENTRIES = 24, 65536


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def positive(c: Column) -> Column:
    return F.coalesce(finite(c) & (c > 0), F.lit(False))


def non_negative(c: Column) -> Column:
    return F.coalesce(finite(c) & (c >= 0), F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def apply_rules(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(id, code) for each rule whose predicate is true; a null predicate counts as not broken."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(c)) for c, p in rules]))
    return rows.select(F.col(key).cast("string").alias("id"), F.explode(codes).alias("code"))


def structure_violations(nodes: DataFrame, edges: DataFrame, root: str | None = None, node_kinds: Sequence[str] = NODE_KINDS,
                         edge_types: Sequence[str] = EDGE_TYPES) -> DataFrame:
    """Unknown kinds and types, duplicate ids, dangling edges, missing root.

    Ids are placed by hash once, for the count and for both ends of edges. They are nearly distinct, so nothing is aggregated before that:
    a table of all ids of a file split would be the largest thing in memory.
    """
    bad = nodes.where(~F.coalesce(F.col("kind").isin(*node_kinds), F.lit(False))).select("id", F.lit("node-kind").alias("code"))
    ids = nodes.select("id").repartition("id")
    dup = ids.groupBy("id").count().where("count > 1").select("id", F.lit("node-duplicate").alias("code"))
    etype = edges.where(~F.coalesce(F.col("type").isin(*edge_types), F.lit(False))).select(
        F.concat_ws(">", "src", "dst").alias("id"), F.lit("edge-type").alias("code"))
    miss = lambda end: edges.join(ids, F.col(end) == ids["id"], "left_anti").select(
        F.concat_ws(">", "src", "dst").alias("id"), F.lit(f"dangling-{end}").alias("code"))
    out = bad.unionByName(dup).unionByName(etype).unionByName(miss("src")).unionByName(miss("dst"))
    if root is not None:
        found = nodes.agg(F.count(F.when((F.col("id") == root) & (F.col("kind") == "project"), 1)).alias("n"))
        out = out.unionByName(found.where("n = 0").select(F.lit(root).alias("id"), F.lit("root-missing").alias("code")))
    return out


def parent_violations(children: DataFrame, edges: DataFrame, nodes: DataFrame, parent_kinds: Sequence[str], code: str) -> DataFrame:
    """Children (id) that do not have exactly one containing parent of an allowed kind."""
    p = nodes.where(F.col("kind").isin(*parent_kinds)).select(F.col("id").alias("src"))
    n = edges.where("type = 'contains'").join(p, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("parents"))
    return children.select("id").join(n, "id", "left").where(F.coalesce("parents", F.lit(0)) != 1).select("id", F.lit(code).alias("code"))


def source_range_violations(clips: DataFrame, footage: DataFrame) -> DataFrame:
    """Clips whose source range runs past the end of their asset."""
    m = footage.select("asset_id", "source_duration")
    over = F.col("in_point") + F.col("duration") * F.col("playback_rate") > F.col("source_duration") + EPS
    return clips.join(m, "asset_id").where(over).select("clip_id", F.lit("source-range").alias("code"))


# --- rule lists per kind (columns named as in the flat tables) ----------------------------------------------------------

def composition_rules() -> list:
    c = F.col
    return [("composition.orphaned", ~c("in_project")), ("composition.dimensions", ~positive(c("width")) | ~positive(c("height"))),
            ("composition.fps", ~positive(c("fps"))), ("composition.duration", ~non_negative(c("duration")))]


def track_rules() -> list:
    return [("track.kind", ~F.coalesce(F.col("asset_kind").isin("visual", "audio"), F.lit(False))),
            ("track.parent", F.coalesce("parents", F.lit(0)) != 1)]


def clip_rules() -> list:
    """Needs the clip joined to its asset (asset_kind, source_duration) and track (track_kind), and edge counts."""
    c = F.col
    asset, track = c("asset_kind"), c("track_kind")
    wants = F.when(asset.isin("audio", "music"), "audio").otherwise("visual")
    end = c("in_point") + c("duration") * c("playback_rate")
    return [("clip.asset", asset.isNull()), ("clip.track", track.isNull()), ("clip.start", ~non_negative(c("start"))),
            ("clip.duration", ~positive(c("duration"))), ("clip.in-point", ~non_negative(F.coalesce("in_point", F.lit(0.0)))),
            ("clip.playback-rate", ~positive(F.coalesce("playback_rate", F.lit(1.0)))),
            ("clip.gain-db", c("gain_db").isNotNull() & ~c("gain_db").between(-96, 24)),
            ("clip.pan", c("pan").isNotNull() & ~c("pan").between(-1, 1)),
            ("clip.fade-in", c("fade_in").isNotNull() & ~non_negative(c("fade_in"))),
            ("clip.fade-out", c("fade_out").isNotNull() & ~non_negative(c("fade_out"))),
            ("clip.containment", F.coalesce("contained", F.lit(0)) != 1), ("clip.reference", F.coalesce("referenced", F.lit(0)) != 1),
            ("clip.track-kind", asset.isNotNull() & track.isNotNull() & (track != wants)),
            ("clip.source-range", track.isNotNull() & (asset != "image") & positive(c("source_duration")) & (end > c("source_duration") + EPS))]


def layer_rules() -> list:
    c, role = F.col, F.coalesce("role", F.lit(""))
    live, text, shape = role != "marker", role == "text", role == "shape"
    plain = live & ~text & ~shape
    return [("layer.parent", live & (F.coalesce("parents", F.lit(0)) != 1)), ("layer.text", text & c("text").isNull()),
            ("layer.font-size", text & ~positive(c("font_size"))),
            ("layer.shape-type", shape & ~F.coalesce(c("shape_type").isin("rectangle", "ellipse"), F.lit(False))),
            ("layer.shape-dimensions", shape & (~positive(c("width")) | ~positive(c("height")))),
            ("layer.asset", plain & c("asset_kind").isNull()),
            ("layer.reference", plain & c("asset_kind").isNotNull() & (F.coalesce("referenced", F.lit(0)) < 1))]


def effect_rules() -> list:
    return [("effect.target", (F.coalesce("targets", F.lit(0)) != 1) | ~F.coalesce(F.col("target_kind").isin("layer", "clip"), F.lit(False))),
            ("effect.type", F.col("effect_type").isNull() | (F.col("effect_type") == ""))]


def output_rules() -> list:
    c = F.col
    return [("output.composition", c("composition_kind").isNull() | (c("composition_kind") != "composition")),
            ("output.dimensions", ~positive(c("width")) | ~positive(c("height"))), ("output.fps", ~positive(c("fps"))),
            ("output.range", ~non_negative(c("range_start")) | ~non_negative(c("range_end")) | (c("range_end") < c("range_start"))),
            ("output.target", F.coalesce("targets", F.lit(0)) != 1), ("output.parent", ~F.coalesce("in_project", F.lit(False)))]


def object_rules(schema: str) -> list:
    c = F.col
    return [("object.schema", F.coalesce(c("schema") != schema, F.lit(True))), ("object.type", blank(c("object_type"))),
            ("object.semantic-id", c("semantic_id").isNotNull() & (F.trim("semantic_id") == "")),
            ("object.confidence", c("confidence").isNotNull() & ~c("confidence").between(0, 1)),
            ("object.tags", c("tags").isNull() | F.exists("tags", lambda x: x.isNull() | (F.trim(x) == ""))),
            ("object.parent", F.coalesce("parents", F.lit(0)) != 1)]


def relation_rules() -> list:
    return [("object.relationship-source", F.coalesce(F.col("source_kind") != "object", F.lit(True))),
            ("object.relationship-role", blank(F.col("role")))]


def keyframe_violations(points: DataFrame, keys: Sequence[str], order: str, span: Column) -> DataFrame:
    """Points of a stored curve that are negative, not finite or earlier than the point listed before them."""
    from .scan import span_scan
    x = span_scan(points, keys, [order], span, __p=("lag", F.col("time")))
    bad = ~finite(F.col("time")) | ~finite(F.col("value")) | (F.col("time") < 0) | F.coalesce(F.col("time") < F.col("__p"), F.lit(False))
    return x.where(bad).select(*keys, order, F.lit("keyframes.value").alias("code"))


# --- payload bounds -----------------------------------------------------------------------------------------------------

_SHAPE = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("entries", T.IntegerType()),
                       T.StructField("finite", T.BooleanType())])


def _shape(text: str) -> tuple[int, int, bool]:
    entries, depth, ok = 0, 0, True
    stack = [(json.loads(text), 0)]
    while stack:
        value, at = stack.pop()
        if isinstance(value, (dict, list)):
            depth = max(depth, at + 1)
            items = list(value.values()) if isinstance(value, dict) else value
            entries += len(items)
            stack.extend((v, at + 1) for v in items)
        elif isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
            ok = False
    return depth, entries, ok


@F.pandas_udf(_SHAPE)
def json_shape(s: pd.Series) -> pd.DataFrame:
    """Nesting depth, number of entries and finiteness of JSON text; all null when it does not parse."""
    rows = []
    for text in s:
        try:
            rows.append(_shape(text))
        except (TypeError, ValueError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["depth", "entries", "finite"]).astype(
        {"depth": "Int32", "entries": "Int32", "finite": "boolean"})


def payload_report(rows: DataFrame, key: str, payload: str, max_bytes: int) -> DataFrame:
    """Bytes, depth and entries of a JSON column with the bounds it breaks."""
    x = rows.select(key, F.octet_length(payload).cast("bigint").alias("bytes"), json_shape(payload).alias("s")).select(
        key, "bytes", "s.depth", "s.entries", "s.finite")
    broken = F.array_compact(F.array(F.when(F.col("bytes") > max_bytes, F.lit("bytes")), F.when(F.col("depth") > MAX_DEPTH, F.lit("depth")),
                                     F.when(F.col("entries") > MAX_ENTRIES, F.lit("entries")), F.when(~F.col("finite"), F.lit("not-finite")),
                                     F.when(F.col("depth").isNull() & F.col("bytes").isNotNull(), F.lit("not-json"))))
    return x.withColumn("broken", F.array_join(broken, ","))
