"""All registered queries. Importing this module fills the registry."""

from driftline.plans import reg_filters, reg_functions, reg_joins, reg_rounds, reg_streaming, reg_views  # noqa: F401
from driftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
