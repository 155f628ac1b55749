"""Registered queries on the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from . import evaluation_queries, model_queries, review_queries, split_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
