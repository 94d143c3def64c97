"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from larkspur.plans import relational, search
from larkspur.sources.tables import sql


def queries() -> dict:
    shared = {n: (lambda spark, sf_dir, n=n: sql(spark, sf_dir, relational.sql(n, relational.Spark))) for n in relational.QUERIES}
    return shared | search.queries()


def oracle_sql() -> dict[str, str]:
    return {n: relational.sql(n, relational.DuckDB) for n in relational.QUERIES} | search.oracle_sql()
