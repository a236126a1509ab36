"""All queries of the library outside the corpus operators."""

from crosspanel.plans import fact_queries, input_queries, report_input_queries, report_queries, score_queries, stream_queries, surrogate_queries, text_queries, universe_queries  # noqa: F401  (importing registers)
from crosspanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
