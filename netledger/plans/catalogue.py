"""All queries of the reference's operators and their DuckDB text."""

from netledger.plans import composites, composites_sql, primitives, primitives_sql, reader_queries

QUERIES = composites.QUERIES | primitives.QUERIES | reader_queries.QUERIES
ORACLE = composites_sql.ORACLE | primitives_sql.ORACLE | reader_queries.ORACLE
