"""All queries over the supplied tables and their SQL for DuckDB."""

from .queries import facts, retrieval, store, temporal

FLAGSHIP = "hybrid_retrieve"
QUERIES = {**temporal.QUERIES, **retrieval.QUERIES, **facts.QUERIES, **store.QUERIES}
ORACLE_SQL = {**temporal.ORACLE_SQL, **retrieval.ORACLE_SQL, **facts.ORACLE_SQL, **store.ORACLE_SQL}
