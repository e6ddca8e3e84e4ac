"""Extension points: user callables run as vectorised UDFs, folds and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.fold import ordered_fold


def verifier(check: Callable[[str], bool]):
    """Boolean UDF from a user check; null input gives null, an exception counts as not verified."""
    def one(x):
        if x is None:
            return None
        try:
            return bool(check(x))
        except Exception:
            return False

    def run(s: pd.Series) -> pd.Series:
        return s.map(one).astype("boolean")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.BooleanType())


def replay_with(log: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], tuple],
                apply: Callable[[tuple, tuple], tuple], columns: Sequence[str], out: str) -> DataFrame:
    """Custom fold of a log: the state is a tuple matching ``out`` and is emitted after every entry.

    The log streams through in order with one state in memory; use ``oplog.replay_nodes`` for the built-in fold.
    """
    def step(state, values):
        state = apply(state, values)
        return state, tuple(state)

    return ordered_fold(log, keys, order, start, step, columns, out)


def invoke_models(requests: DataFrame, plan: str, payload: str, models: Mapping[str, Callable[[list], Sequence]], result: str, batch_size: int = 32) -> DataFrame:
    """``requests`` with backend_id, ``result`` (a type) as column result, attempts and error, from user models called in batches.

    ``plan`` is an array of backend ids in order of preference. Each round calls, for every backend that is next for some rows, its model with
    the payloads of these rows; a row whose model gives an exception object, raises, or has no model moves on to the next backend. A model
    that raises fails its whole batch, one that returns the wrong number of results too. Rows without a plan left have a null backend and the
    last error. One Arrow batch of rows is in memory.
    """
    types = dict(requests.dtypes)
    attempt = "array<struct<backend_id:string,ok:boolean>>"
    schema = ", ".join([*(f"`{n}` {t}" for n, t in types.items()), "backend_id string", f"result {result}", f"attempts {attempt}", "error string"])

    def called(model: Callable[[list], Sequence] | None, values: list) -> list:
        if model is None:
            return [LookupError("no such backend")] * len(values)
        try:
            got = list(model(values))
        except Exception as e:
            return [e] * len(values)
        return got if len(got) == len(values) else [ValueError(f"model must return exactly {len(values)} results")] * len(values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n = len(pdf)
            plans, values = [list(p) if p is not None else [] for p in pdf[plan]], list(pdf[payload])
            backend, results, tries, errors = [None] * n, [None] * n, [[] for _ in range(n)], [None] * n
            left, turn = [k for k in range(n) if plans[k]], 0
            while left:
                waiting: dict[str, list[int]] = {}
                for k in left:
                    waiting.setdefault(plans[k][turn], []).append(k)
                for name, rows in sorted(waiting.items()):
                    for at in range(0, len(rows), batch_size):
                        part = rows[at:at + batch_size]
                        for k, got in zip(part, called(models.get(name), [values[k] for k in part])):
                            good = not isinstance(got, Exception)
                            tries[k].append({"backend_id": name, "ok": good})
                            backend[k], results[k], errors[k] = (name, got, None) if good else (None, None, str(got))
                turn += 1
                left = [k for k in left if backend[k] is None and turn < len(plans[k])]
            yield pdf.assign(backend_id=backend, result=pd.Series(results, dtype=object, index=pdf.index), attempts=tries, error=errors)

    return requests.mapInPandas(run, schema)
