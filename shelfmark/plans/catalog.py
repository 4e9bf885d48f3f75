"""All registered queries."""

from . import queries_files, queries_graph, queries_ledger, queries_search, queries_stream, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
