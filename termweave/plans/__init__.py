"""The registered queries over the relational test tables, and their oracles."""

from . import assoc_queries, etl_queries, graph_queries, node_queries, rule_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
