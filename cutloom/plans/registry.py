"""Named queries and, where SQL can state them, the equivalent DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB text of the domain views (same columns as sources/views.py).
_REL = "(epoch_us(ts)-epoch_us(timestamp '2024-01-01'))"
VIEW_SQL = {
    "v_intervals": f"""select event_id as clip_id, event_type as track_id, {_REL}/1e6 as start, value as duration,
        cast(event_id%7 as double) as in_point,
        case when event_id%3=0 then cast(2 as double) else cast(1 as double) end as playback_rate,
        event_id%11<>0 as enabled, event_id%2000 as asset_id from events""",
    "v_points": f"""select user_id as series_id, {_REL}/1e6 as time, value,
        case event_id%5 when 0 then 'linear' when 1 then 'hold' when 2 then 'ease-in' when 3 then 'ease-out'
        else 'ease-in-out' end as easing, event_id as ordinal from events""",
    "v_chunks": f"""select user_id as track_id, {_REL} as timestamp_us,
        cast(round(value*1e6) as bigint) as duration_us, event_id%4096 as byte_length,
        event_type='purchase' as is_key, row_number() over (partition by user_id order by event_id) as sequence,
        event_id%16 as counter, (event_id*104729)%8589934592 as raw33, event_id from events""",
    "v_ops": f"""select user_id as project_id, row_number() over (partition by user_id order by ts,event_id) as seq,
        event_id as tx_id, {_REL} as at_us,
        case event_type when 'signup' then 'node.add' when 'error' then 'node.remove'
        when 'purchase' then 'edge.add' else 'node.update' end as op_type,
        event_id%20 as entity_id, 'p'||(event_id%4) as prop, value from events""",
    "v_edges": """select 'R'||n_regionkey as src,'N'||n_nationkey as dst,'contains' as type from nation
        union all select 'N'||c_nationkey,'C'||c_custkey,'contains' from customer
        union all select 'C'||o_custkey,'O'||o_orderkey,'contains' from orders
        union all select 'O'||l_orderkey,'P'||l_partkey,'references' from lineitem""",
    "v_nodes": """select 'R'||r_regionkey as id,'project' as kind,r_name as name from region
        union all select 'N'||n_nationkey,'composition',n_name from nation
        union all select 'C'||c_custkey,'track',c_name from customer
        union all select 'O'||o_orderkey,'clip','clip '||o_orderkey from orders
        union all select 'P'||p_partkey,'asset',p_name from part""",
    "v_ranges": """select l_suppkey as source_id,
        row_number() over (partition by l_suppkey order by l_orderkey,l_linenumber,l_partkey,l_extendedprice) as idx,
        (l_orderkey*64+l_linenumber)%1000000 as off, cast(l_quantity as bigint)*16 as len from lineitem""",
    "v_job_chunks": """select l_orderkey as job_id, cast(l_linenumber as bigint) as idx, l_partkey, l_extendedprice,
        cast(l_quantity as bigint) as frame_count,
        case when l_linestatus='F' and l_returnflag='R' then 'failed' when l_linestatus='F' then 'complete'
        when l_returnflag='N' and l_discount>0.08 then 'running' else 'pending' end as status,
        cast(round(l_tax*100) as bigint)%4 as attempts, 3 as max_attempts from lineitem""",
    "v_runs": f"""select event_id as run_id, event_type as kind, 'env'||(user_id%5) as environment,
        case when event_id%13=0 then 'skipped' when event_type='error' then 'failed' else 'passed' end as status,
        {_REL} as at_us, value as index_ms, value/(1+event_id%9) as read_amplification from events""",
    "v_stages": """select user_id as variant, event_id//5 as source_key,
        case event_id%5 when 1 then 'submitted' when 2 then 'decoded' when 3 then 'output' else 'source' end as stage,
        cast(epoch_us(ts) as double)/1000 as at_ms, event_id from events""",
    "v_tracks": """select distinct event_type as track_id, case when event_type='error' then 'audio' else 'visual' end as asset_kind,
        event_type='view' as locked, event_type='click' as muted, ascii(event_type) as ord from events""",
    "v_footage": """select p_partkey as asset_id, p_retailprice/10 as source_duration,
        case when p_size%6=0 then 'image' when p_size%6 in (1,2) then 'audio' else 'video' end as asset_kind,
        cast(p_size*97 as double) as width, cast(p_size*53 as double) as height from part""",
    "v_effects": """select l_orderkey as target_id, l_linenumber as ord,
        l_partkey*10000000 + cast(round(l_extendedprice*10) as bigint)%10000000 as effect_id,
        case l_returnflag when 'A' then 'blur' when 'N' then 'gain' else 'hue' end as effect_type, l_linestatus='O' as enabled,
        l_quantity as amount from lineitem""",
    "v_packed": f"""select event_id as clip_id, event_type as track_id,
        coalesce(sum(value) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as start,
        value as duration, cast(event_id%7 as double) as in_point,
        case when event_id%3=0 then cast(2 as double) else cast(1 as double) end as playback_rate,
        event_id%11<>0 as enabled, event_id%2000 as asset_id from events""",
    "v_samples": """select event_type as buffer_id, user_id%2 as channel,
        row_number() over (partition by event_type, user_id%2 order by event_id)-1 as i, (value-100)/400 as v from events""",
    "v_objects": """select 'B'||p_partkey as object_id, p_name as name, p_type as object_type,
        case when p_partkey%3<>0 then p_brand||':'||(p_partkey%100) end as semantic_id, [p_brand, 'size'||(p_size%5)] as tags from part""",
    "v_relations": """select concat_ws('-','E',l_orderkey,l_linenumber,l_partkey,l_suppkey) as edge_id, 'S'||l_suppkey as object_id,
        case when l_linenumber%2=0 then 'P'||l_partkey else 'O'||l_orderkey end as target_id,
        case l_returnflag when 'A' then 'appears-in' when 'N' then 'generated-representation' end as role from lineitem""",
    "v_clip_assets": "select 'O'||o_orderkey as clip_id, 'P'||(o_orderkey%200) as asset_id from orders",
    "v_docs": "select doc_id as id, lang as kind, source as name, text from documents",
    "v_assets": """select doc_id as id, sha256(text) as hash, n_chars as size, source as owner, lang as mime
        from documents""",
}


def with_views(text: str) -> str:
    """Prefix the views a query mentions as common table expressions."""
    body = text.strip()
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    ctes = ", ".join(f"{v} as ({VIEW_SQL[v]})" for v in used)
    lead = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if lead:
        return f"with {lead.group(1) or ''}{ctes}, {body[lead.end():]}"
    return f"with {ctes} {body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn
    return register
