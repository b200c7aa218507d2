"""Registered queries, each beside the SQL text that checks it."""

from __future__ import annotations

from tallyfield.queries import (  # noqa: F401  (importing registers)
    counts,
    feeds,
    ids,
    likelihood,
    models,
    space,
    taxa,
)
from tallyfield.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
