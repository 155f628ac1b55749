"""Operators of a training-data pipeline.  Nothing else in the library imports this folder."""

from .registry import ORACLES, QUERIES


def all_queries():
    from . import queries  # noqa: F401  registers on import

    return dict(QUERIES)


def all_oracles():
    from . import queries  # noqa: F401

    return dict(ORACLES)
