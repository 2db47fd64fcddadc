"""All named queries of the engine and the SQL that checks them."""

from . import correction_queries, metric_queries, quality_queries, relational_queries, stream_queries, summary_queries, text_queries

_MODULES = (quality_queries, text_queries, metric_queries, relational_queries, summary_queries, correction_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
