"""All registered queries and the SQL that checks them."""

from tessella.plans import derived_queries, library_queries, more_queries, oracles, queries

QUERIES = {**queries.QUERIES, **more_queries.QUERIES, **library_queries.QUERIES, **derived_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **library_queries.ORACLES, **derived_queries.ORACLES}

__all__ = ["ORACLES", "QUERIES"]
