"""Every query of the library, by name."""

from flowlens.plans import deep_queries, flow_queries, model_queries, more_queries, score_queries, study_queries  # noqa: F401
from flowlens.plans.views import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
