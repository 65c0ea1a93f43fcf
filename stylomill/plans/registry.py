"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from stylomill.plans import model_queries, queries

QUERIES: dict = dict(queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(queries.ORACLE_SQL)


def flagship(spark, sf_dir):
    """The rules and prevalence pipeline, end to end."""
    return model_queries.submission(spark, sf_dir)
