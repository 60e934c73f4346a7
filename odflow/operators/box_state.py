"""Mergeable state of custom boxes (A11, U3, Q5): boxes come and go without a new pass over all trips.

The state is one row per (box, zone): rows, present weights and their sum.  States of different
boxes are stacked with ``unionByName``; a box is taken away by leaving out its rows.  What a
redraw shows - threshold, the missing-weight rule, the cap - is computed from the merged state,
whose size is boxes times zones, whatever the number of trips.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators._broadcast import materialize
from odflow.operators.flows import cap_at_quantile
from odflow.operators.selection import _box_ends

_KEYS = ["box_id", "orig_lon", "orig_lat", "dest", "dest_lon", "dest_lat"]


def box_state(trips: DataFrame, boxes: DataFrame, zones: DataFrame, direction: str = "orig",
              linked: bool = False, filters: Mapping[str, Sequence | None] | None = None,
              w: str = "w", m: str = "m", o_lon: str = "o_lon", o_lat: str = "o_lat",
              d_lon: str = "d_lon", d_lat: str = "d_lat") -> DataFrame:
    """State of ``boxes``: ``box_id, orig point, dest, dest point, rows, present, total``, written.

    Only trips with an end inside the boxes' common bounding box are located, so one more box
    costs one box.
    """
    far = _box_ends(trips, boxes, zones, direction, linked, filters, w, m, o_lon, o_lat, d_lon, d_lat, None, None)
    return materialize(far.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("rows"), F.count("_wt").alias("present"),
                                               F.coalesce(F.sum("_wt"), F.lit(0.0)).alias("total")))


def _merged(state: DataFrame, keys: Sequence[str], min_n: float) -> DataFrame:
    """One row per ``keys`` with ``N``: missing as soon as one weight is, and then dropped."""
    g = state.groupBy(*keys).agg(F.sum("rows").alias("_r"), F.sum("present").alias("_p"), F.sum("total").alias("N"))
    return g.where((F.col("_r") == F.col("_p")) & (F.col("N") >= F.lit(min_n))).drop("_r", "_p")


def heat_from_state(state: DataFrame, min_n: float = 0, p: float = 0.95) -> DataFrame:
    """Heat by zone over all boxes of the state, as :func:`odflow.operators.selection.box_heat`."""
    return cap_at_quantile(materialize(_merged(state, _KEYS[3:], min_n)), "N", p, "colN")


def flows_from_state(state: DataFrame, min_n: float = 0, p: float = 0.95) -> DataFrame:
    """Flows per box, capped per box, as :func:`odflow.operators.selection.box_flows`."""
    return cap_at_quantile(materialize(_merged(state, _KEYS, min_n)), "N", p, "colN", by=["box_id"])
