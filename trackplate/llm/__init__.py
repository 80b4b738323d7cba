"""Operators for preparing training text. Nothing else in the library imports this package."""

from .registry import ORACLES, QUERIES


def _load() -> None:
    from . import catalog  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
