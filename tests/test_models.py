"""User models: batches, fallback, wrong answers."""

from cutloom.functions.udf import invoke_models


def test_fallback_row_by_row(spark):
    def even(values):
        return [v if v % 2 == 0 else ValueError("odd") for v in values]

    def short(values):
        return values[1:]

    rows = [(1, ["short", "even", "all"]), (2, ["even"]), (3, ["even"]), (4, []), (5, None), (6, ["none", "all"])]
    df = spark.createDataFrame(rows, "v int, plan array<string>").repartition(1)
    got = {r.v: r for r in invoke_models(df, "plan", "v", {"even": even, "short": short, "all": lambda vs: [v * 10 for v in vs]}, "int", 2).collect()}
    assert {v: (r.backend_id, r.result, [a.ok for a in r.attempts]) for v, r in got.items()} == {
        1: ("all", 10, [False, False, True]), 2: ("even", 2, [True]), 3: (None, None, [False]), 4: (None, None, []), 5: (None, None, []),
        6: ("all", 60, [False, True])}
    assert got[3].error == "odd" and got[1].error is None
    assert invoke_models(df.limit(0), "plan", "v", {}, "int").count() == 0
