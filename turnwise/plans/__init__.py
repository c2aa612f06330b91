"""Jobs and registered queries."""
from turnwise.plans import change_queries, log_queries, policy_queries, prose_queries, report_queries, stream_queries, tree_queries, usage_queries  # noqa: F401
from turnwise.plans.registry import ORACLES, QUERIES  # noqa: F401
