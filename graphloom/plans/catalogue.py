"""Every registered query of the library and its SQL."""

from __future__ import annotations

from . import queries_branches, queries_carving, queries_change, queries_graph, queries_index, queries_more, queries_rules, queries_search, queries_streams, queries_text  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
