"""All registered queries of the code-facts operators and their DuckDB SQL."""

from __future__ import annotations

from quarry.plans import editor, facts, further, graphs, patterns, sourcecode, sources, streams, texts  # noqa: F401  registers the queries
from quarry.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
