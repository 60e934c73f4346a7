"""Column-level building blocks: built-in Spark expressions only, no Python UDFs."""

from odflow.functions.weights import na_sum, na_sum_over, weight_col
from odflow.functions.text import (
    blank_to_null_col, concat_parts, first_token, flow_label, percent_text, remap,
    thousands, to_number, transfer_chain,
)
from odflow.functions.geo import (
    crossing_count, great_circle_params, great_circle_point, great_circle_vertices, inside_ring, on_ring_edge, ring_centroid_mercator,
)

__all__ = [
    "na_sum", "na_sum_over", "weight_col",
    "blank_to_null_col", "concat_parts", "first_token", "flow_label", "percent_text", "remap",
    "thousands", "to_number", "transfer_chain",
    "crossing_count", "great_circle_params", "great_circle_point", "great_circle_vertices", "inside_ring", "on_ring_edge",
    "ring_centroid_mercator",
]
