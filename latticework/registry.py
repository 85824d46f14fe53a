"""All queries of the engine over the driver's tables, with the SQL that each must equal."""

from latticework.plans import detector_queries, path_queries, queries

QUERIES = queries.QUERIES | path_queries.QUERIES | detector_queries.QUERIES
ORACLES = queries.ORACLES | path_queries.ORACLES | detector_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]
