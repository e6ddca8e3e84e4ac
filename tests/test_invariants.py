"""Rules over time: against a replay of every project op by op."""

import random

import pytest

from cutloom.operators import invariants as I
from cutloom.operators.scan import span_of

SCHEMA = "project_id long, seq long, kind string, op_type string, entity_id long, other_id long, edge_id long, prop string, value double, edge_type string"
RULES = (I.ValueRule("clip", "start", "clip.start", "value >= 0"), I.ValueRule("clip", "pan", "clip.pan", "value between -1 and 1", 0.0),
         I.ParentRule("track", ("composition",), "track.parent"), I.ParentRule("object", ("project", "object"), "object.parent", alone=True))


def grow(r, project, n):
    """A log whose ops all apply."""
    nodes, edges, out = {}, {}, []
    for seq in range(n):
        kind = r.choice(["add", "add", "edge", "edge", "edge", "update", "update", "unedge", "remove"])
        row = dict.fromkeys(SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))
        row |= {"project_id": project, "seq": seq}
        if kind == "add" or not nodes:
            x = r.randrange(30)
            if x in nodes:
                continue
            nodes[x] = r.choice(["clip", "track", "object", "composition", "project"])
            row |= {"op_type": "node.add", "entity_id": x, "kind": nodes[x], "prop": r.choice(["start", "pan", None]), "value": r.choice([-2.0, 0.5])}
        elif kind == "edge":
            a, b = r.choice(list(nodes)), r.choice(list(nodes))
            edges[seq] = (a, b)
            row |= {"op_type": "edge.add", "entity_id": a, "other_id": b, "edge_id": seq, "edge_type": r.choice(["contains", "contains", "targets"])}
        elif kind == "update":
            row |= {"op_type": "node.update", "entity_id": r.choice(list(nodes)), "prop": r.choice(["start", "pan", "fps"]), "value": r.choice([-2.0, 0.5, None])}
        elif kind == "unedge" and edges:
            x = r.choice(list(edges))
            del edges[x]
            row |= {"op_type": "edge.remove", "edge_id": x}
        elif kind == "remove":
            x = r.choice(list(nodes))
            del nodes[x]
            edges = {k: e for k, e in edges.items() if x not in e}
            row |= {"op_type": "node.remove", "entity_id": x}
        else:
            continue
        out.append(row)
    return out


def broken_now(nodes, edges):
    """{(entity, code)} by the rules above; nodes {id: (kind, props)}, edges {id: (from, to)} of containment."""
    out = set()
    for x, (kind, props) in nodes.items():
        parents = [nodes[a][0] for a, b in edges.values() if b == x]
        if kind == "clip":
            start, pan = props.get("start"), props.get("pan", 0.0)
            out |= {(x, c) for c, bad in (("clip.start", start is None or start < 0), ("clip.pan", pan is None or not -1 <= pan <= 1)) if bad}
        if kind == "track" and parents.count("composition") != 1:
            out.add((x, "track.parent"))
        if kind == "object" and (len(parents) != 1 or parents[0] not in ("project", "object")):
            out.add((x, "object.parent"))
    return out


def replayed(ops):
    """{(entity, code): since} after the last op."""
    nodes, edges, since = {}, {}, {}
    for o in ops:
        if o["op_type"] == "node.add":
            nodes[o["entity_id"]] = (o["kind"], {o["prop"]: o["value"]} if o["prop"] else {})
        elif o["op_type"] == "node.update":
            nodes[o["entity_id"]][1][o["prop"]] = o["value"]
        elif o["op_type"] == "node.remove":
            del nodes[o["entity_id"]]
            edges = {k: e for k, e in edges.items() if o["entity_id"] not in e}
        elif o["op_type"] == "edge.add" and o["edge_type"] == "contains":
            edges[o["edge_id"]] = (o["entity_id"], o["other_id"])
        elif o["op_type"] == "edge.remove":
            edges.pop(o["edge_id"], None)
        bad = broken_now(nodes, edges)
        since = {k: since.get(k, o["seq"]) for k in bad}
    return since


@pytest.fixture(scope="module")
def logs():
    r = random.Random(3)
    return {p: grow(r, p, 60) for p in range(25)}


def frame(spark, logs):
    return spark.createDataFrame([tuple(o.values()) for ops in logs.values() for o in ops], SCHEMA).repartition(5)


def test_broken_rules_equal_the_replay(spark, logs):
    got = {(x.project_id, x.entity_id, x.code): x.since for x in I.broken_rules(frame(spark, logs), span_of("seq", 16), 16, RULES).collect()}
    assert got == {(p, *k): s for p, ops in logs.items() for k, s in replayed(ops).items()}


def test_preflight_names_the_op_to_blame(spark, logs):
    ops = {p: [dict(o) for o in log] for p, log in logs.items()}
    for p in (3, 4):
        ops[p].append(ops[p][-1] | {"seq": 99, "op_type": "node.update", "entity_id": 77})
    got = {x.project_id: (x.seq, x.phase, x.code) for x in I.preflight(frame(spark, ops), span_of("seq", 16), 16, None, RULES).collect()}
    want = {}
    for p, log in logs.items():
        ends = replayed(log)
        if p in (3, 4):
            want[p] = (99, "apply", "unknown-node")
        elif ends:
            want[p] = min((s, "invariants", code) for (_, code), s in ends.items())
    assert got == want and {x[1] for x in want.values()} == {"apply", "invariants"}


def test_rules_that_are_mended_do_no_harm(spark):
    base = dict.fromkeys(SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))
    rows = [{"op_type": "node.add", "entity_id": 1, "kind": "clip"}, {"op_type": "node.update", "entity_id": 1, "prop": "start", "value": 2.0},
            {"op_type": "node.update", "entity_id": 1, "prop": "pan", "value": 3.0}, {"op_type": "node.update", "entity_id": 1, "prop": "pan", "value": 1.0},
            {"op_type": "node.add", "entity_id": 2, "kind": "track"}, {"op_type": "node.remove", "entity_id": 2}]
    df = frame(spark, {1: [base | {"project_id": 1, "seq": k} | x for k, x in enumerate(rows)]})
    assert I.preflight(df, span_of("seq", 2), 2, None, RULES).count() == 0
    assert I.preflight(df.limit(0), span_of("seq", 2), 2, None, RULES).count() == 0
    assert [(x.seq, x.code) for x in I.preflight(df.where("seq <> 1 and seq <> 5"), span_of("seq", 2), 2, None, RULES).collect()] == [(0, "clip.start")]
