"""Domain views: the timeline, log, graph and ledger tables seen in the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.scan import span_of, span_scan
from .tables import EPOCH_US, Tables, micros

_REL_US = f"{micros('ts')} - {EPOCH_US}"


def intervals(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id as clip_id", "event_type as track_id", f"({_REL_US})/1e6 as start", "value as duration",
        "cast(event_id%7 as double) as in_point",
        "case when event_id%3=0 then cast(2 as double) else cast(1 as double) end as playback_rate",
        "event_id%11<>0 as enabled", "event_id%2000 as asset_id")


def points(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "user_id as series_id", f"({_REL_US})/1e6 as time", "value",
        "case event_id%5 when 0 then 'linear' when 1 then 'hold' when 2 then 'ease-in' when 3 then 'ease-out' "
        "else 'ease-in-out' end as easing", "event_id as ordinal")


def chunks(t: Tables) -> DataFrame:
    base = t.events.selectExpr(
        "user_id as track_id", f"{_REL_US} as timestamp_us", "cast(round(value*1e6) as bigint) as duration_us",
        "event_id%4096 as byte_length", "event_type='purchase' as is_key", "event_id%16 as counter",
        "(event_id*104729)%8589934592 as raw33", "event_id")
    return span_scan(base, ["track_id"], ["event_id"], span_of("event_id", 1 << 20), sequence=("row_number",))


def ops(t: Tables) -> DataFrame:
    base = t.events.selectExpr(
        "user_id as project_id", "event_id as tx_id", f"{_REL_US} as at_us",
        "case event_type when 'signup' then 'node.add' when 'error' then 'node.remove' "
        "when 'purchase' then 'edge.add' else 'node.update' end as op_type",
        "event_id%20 as entity_id", "concat('p', event_id%4) as prop", "value")
    return span_scan(base, ["project_id"], ["at_us", "tx_id"], span_of("at_us", 86400e6), seq=("row_number",))


def edges(t: Tables) -> DataFrame:
    contains, references = F.lit("contains"), F.lit("references")

    def edge(df, sp, s, dp, d, kind):
        return df.select(F.concat(F.lit(sp), s).alias("src"), F.concat(F.lit(dp), d).alias("dst"), kind.alias("type"))

    return (edge(t.nation, "R", "n_regionkey", "N", "n_nationkey", contains)
            .unionByName(edge(t.customer, "N", "c_nationkey", "C", "c_custkey", contains))
            .unionByName(edge(t.orders, "C", "o_custkey", "O", "o_orderkey", contains))
            .unionByName(edge(t.lineitem, "O", "l_orderkey", "P", "l_partkey", references)))


def nodes(t: Tables) -> DataFrame:
    def node(df, prefix, key, kind, name):
        return df.select(F.concat(F.lit(prefix), key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"))

    return (node(t.region, "R", "r_regionkey", "project", F.col("r_name"))
            .unionByName(node(t.nation, "N", "n_nationkey", "composition", F.col("n_name")))
            .unionByName(node(t.customer, "C", "c_custkey", "track", F.col("c_name")))
            .unionByName(node(t.orders, "O", "o_orderkey", "clip", F.concat(F.lit("clip "), "o_orderkey")))
            .unionByName(node(t.part, "P", "p_partkey", "asset", F.col("p_name"))))


def ranges(t: Tables) -> DataFrame:
    base = t.lineitem.selectExpr("l_suppkey as source_id", "l_orderkey", "l_linenumber", "l_partkey",
                                 "l_extendedprice", "(l_orderkey*64+l_linenumber)%1000000 as off",
                                 "cast(l_quantity as bigint)*16 as len")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return span_scan(base, ["source_id"], order, span_of("l_orderkey", 1 << 20), idx=("row_number",)).select(
        "source_id", "idx", "off", "len")


def job_chunks(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_orderkey as job_id", "cast(l_linenumber as bigint) as idx", "l_partkey", "l_extendedprice",
        "cast(l_quantity as bigint) as frame_count",
        "case when l_linestatus='F' and l_returnflag='R' then 'failed' when l_linestatus='F' then 'complete' "
        "when l_returnflag='N' and l_discount>0.08 then 'running' else 'pending' end as status",
        "cast(round(l_tax*100) as bigint)%4 as attempts", "3 as max_attempts")


def runs(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id as run_id", "event_type as kind", "concat('env', user_id%5) as environment",
        "case when event_id%13=0 then 'skipped' when event_type='error' then 'failed' else 'passed' end as status",
        f"{_REL_US} as at_us", "value as index_ms", "value/(1+event_id%9) as read_amplification")


def stages(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "user_id as variant", "event_id div 5 as source_key",
        "case event_id%5 when 1 then 'submitted' when 2 then 'decoded' when 3 then 'output' else 'source' end as stage",
        f"cast({micros('ts')} as double)/1000 as at_ms", "event_id")


def docs(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id as id", "lang as kind", "source as name", "text")


def assets(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id as id", "sha2(text, 256) as hash", "n_chars as size", "source as owner",
                                  "lang as mime")


def tracks(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("track_id")).distinct().selectExpr(
        "track_id", "case when track_id='error' then 'audio' else 'visual' end as asset_kind", "track_id='view' as locked",
        "track_id='click' as muted", "ascii(track_id) as ord")


def footage(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey as asset_id", "p_retailprice/10 as source_duration",
        "case when p_size%6=0 then 'image' when p_size%6 in (1,2) then 'audio' else 'video' end as asset_kind",
        "cast(p_size*97 as double) as width", "cast(p_size*53 as double) as height")


def packed(t: Tables) -> DataFrame:
    """The same clips laid end to end on their tracks, in time order."""
    iv = intervals(t)
    x = span_scan(iv.withColumnRenamed("start", "at"), ["track_id"], ["at", "clip_id"], span_of("at", 86400.0),
                  start=("sum_before", F.col("duration")))
    return x.select(*iv.columns)


def effects(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_orderkey as target_id", "l_linenumber as ord",
        "cast(l_partkey as bigint) * 10000000 + cast(round(l_extendedprice*10) as bigint) % 10000000 as effect_id",
        "case l_returnflag when 'A' then 'blur' when 'N' then 'gain' else 'hue' end as effect_type", "l_linestatus='O' as enabled",
        "l_quantity as amount")


def samples(t: Tables) -> DataFrame:
    """Two-channel sample buffers: one per event type, channel by user parity, in event order."""
    base = t.events.selectExpr("event_type as buffer_id", "user_id%2 as channel", "event_id", "(value-100)/400 as v")
    x = span_scan(base, ["buffer_id", "channel"], ["event_id"], span_of("event_id", 1 << 20), i=("row_number",))
    return x.select("buffer_id", "channel", (F.col("i") - 1).alias("i"), "v")


def objects(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("B"), "p_partkey").alias("object_id"), F.col("p_name").alias("name"), F.col("p_type").alias("object_type"),
                         F.when(F.col("p_partkey") % 3 != 0, F.concat_ws(":", "p_brand", F.col("p_partkey") % 100)).alias("semantic_id"),
                         F.array("p_brand", F.concat(F.lit("size"), F.col("p_size") % 5)).alias("tags"))


def relations(t: Tables) -> DataFrame:
    """Suppliers as objects that relate to parts (assets) and orders (clips)."""
    return t.lineitem.select(
        F.concat_ws("-", F.lit("E"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"),
        F.concat(F.lit("S"), "l_suppkey").alias("object_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("P"), "l_partkey")).otherwise(F.concat(F.lit("O"), "l_orderkey")).alias("target_id"),
        F.when(F.col("l_returnflag") == "A", "appears-in").when(F.col("l_returnflag") == "N", "generated-representation").alias("role"))


def clip_assets(t: Tables) -> DataFrame:
    return t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("clip_id"), F.concat(F.lit("P"), F.col("o_orderkey") % 200).alias("asset_id"))
