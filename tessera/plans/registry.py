"""All queries of the library's own operators, and their SQL."""

from tessera.plans import evaluation, ingestion, operations, relational, retrieval, streams, trees

MODULES = (retrieval, ingestion, trees, operations, relational, evaluation, streams)
FLAGSHIP = "hybrid_retrieval"
QUERIES = {name: f for m in MODULES for name, f in m.query.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.query.sql.items()}
