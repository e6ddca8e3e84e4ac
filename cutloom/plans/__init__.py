"""Query registry. Importing the area modules fills it."""

from importlib import import_module

from .registry import ORACLES, QUERIES

AREAS = ["search", "chunks", "reports", "timeline", "graph", "oplog", "storage", "delivery", "streams"]


def _load():
    for area in AREAS:
        import_module(f"{__name__}.{area}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
