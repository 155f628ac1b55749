"""The registered op queries: each operator on its whole table with production parameters."""

from __future__ import annotations

from . import op_queries  # noqa: F401
