"""Every operator as a registered query over the given tables."""

from __future__ import annotations

from .registry import ORACLES, QUERIES


def _load() -> None:
    from . import assay_queries, box_queries, file_queries, fragment_queries, parse_queries, plan_queries, track_queries  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
