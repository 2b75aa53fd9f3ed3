"""The registered queries."""

from labelkit.plans import array_queries, data_queries, eval_queries, image_queries, rule_queries, text_queries  # noqa: F401
from labelkit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
