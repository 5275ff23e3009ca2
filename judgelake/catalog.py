"""Registered queries of the evaluation engine and their SQL equivalents."""

from judgelake.plans import oracles, queries, result_oracles, result_queries

QUERIES = {**queries.QUERIES, **result_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **result_oracles.ORACLES}

__all__ = ["ORACLES", "QUERIES"]
