"""Import every query family so that the registry is complete."""

from odflow.plans import q_contours, q_flows, q_more, q_other, q_segments, q_spatial, q_survey, q_tables  # noqa: F401
from odflow.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
