"""Origin-destination flows.

Canonical ``zone_trips`` columns: ``orig, orig_lon, orig_lat, dest, dest_lon, dest_lat``
(zone ids and the zones' points), weights ``w`` / ``m``, and filter columns such as
``route``, ``route_type``, ``time_period``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions.geo import great_circle_params, great_circle_point, great_circle_vertices
from odflow.functions.text import flow_label
from odflow.functions.weights import na_sum, weight_col
from odflow.operators._broadcast import materialize, one_row
from odflow.operators.filters import complete, filter_in, select_zones_in
from odflow.operators.quantile import exact_quantiles

OD_PAIRS = (("orig", "dest"), ("orig_lat", "dest_lat"), ("orig_lon", "dest_lon"))
FLOW_KEYS = ["orig", "orig_lat", "orig_lon", "dest", "dest_lat", "dest_lon"]


def swap_od(df: DataFrame, pairs: Sequence[tuple[str, str]] = OD_PAIRS) -> DataFrame:
    """Origin columns become destination columns and back (P14), zones and points alike."""
    swap = {}
    for a, b in pairs:
        swap[a], swap[b] = b, a
    return df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns])


def with_reverse(df: DataFrame, pairs: Sequence[tuple[str, str]] = OD_PAIRS,
                 role: str | None = None) -> DataFrame:
    """Rows plus their swapped copy (U2), read in one pass.

    Each row explodes into its forward and swapped form, so a costly input plan is
    evaluated once instead of twice as a self-union would.  ``role`` optionally names a
    column tagging the copies ``"orig"`` / ``"dest"``.
    """
    swap = {}
    for a, b in pairs:
        swap[a], swap[b] = b, a
    cols = df.columns
    fwd = F.struct(*[F.col(c).alias(c) for c in cols],
                   *([F.lit("orig").alias(role)] if role else []))
    rev = F.struct(*[F.col(swap.get(c, c)).alias(c) for c in cols],
                   *([F.lit("dest").alias(role)] if role else []))
    return df.select(F.explode(F.array(fwd, rev)).alias("_r")).select("_r.*")


def orient(df: DataFrame, direction: str, pairs: Sequence[tuple[str, str]] = OD_PAIRS
           ) -> DataFrame:
    """``orig`` keeps the table, ``dest`` swaps it, ``both`` stacks the two."""
    if direction == "orig":
        return df
    if direction == "dest":
        return swap_od(df, pairs)
    if direction == "both":
        return with_reverse(df, pairs)
    raise ValueError("direction must be 'orig', 'dest' or 'both'")


def cap_at_quantile(df: DataFrame, col: str = "N", p: float = 0.95, out: str = "colN",
                    by: Sequence[str] | None = None) -> DataFrame:
    """Cap a value at its p-quantile over the whole result, or per ``by`` group.

    The quantile is R's default (linear interpolation) over an aggregated result (one row per
    zone pair or zone), by distributed ranks of its distinct values
    (:func:`odflow.operators.quantile.exact_quantiles`).  ``df`` is read twice, so callers
    pass a written table.
    """
    q = exact_quantiles(df, col, p, by or (), out="_q")
    joined = df.join(q, list(by), "inner") if by else df.crossJoin(one_row(q))
    c = F.col(col)
    return joined.withColumn(out, F.when(c >= F.col("_q"), F.col("_q")).otherwise(c)).drop("_q")


def intensity(df: DataFrame, col: str = "colN", out: str = "intensity") -> DataFrame:
    """Position of a value in the result's range, 0..1 (A9); 0.5 when the range is empty."""
    r = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return df.crossJoin(one_row(r)).withColumn(
        out, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(0.5))
    ).drop("_lo", "_hi")


def od_flows(zone_trips: DataFrame, direction: str = "orig",
             filters: Mapping[str, Sequence | None] | None = None,
             selection: Sequence | DataFrame | None = None, linked: bool = False, min_n: float = 0,
             exclude_self: bool = False, p: float = 0.95, w: str = "w", m: str = "m"
             ) -> DataFrame:
    """Weighted flows between zone pairs with a capped value (A2).

    ``selection`` is a list of zone ids, or a table with a ``zone_id`` column (a selection of
    any length, matched by joins).

    direction -> filters -> selection (origin in it; optionally destination not in it) ->
    ``N = na_sum(weight)`` per (orig, point, dest, point) -> ``N >= min_n`` -> complete
    cases -> ``colN`` capped at the p-quantile of ``N``.

    For ``both`` the selection is applied before the explode as well (a trip can only
    contribute when one of its ends is selected), which keeps the doubled stream small.
    """
    t = filter_in(zone_trips, filters)
    if isinstance(selection, DataFrame):
        t = orient(t.select(*FLOW_KEYS, weight_col(linked, w, m).alias("_wt")), direction)
        t, selection = select_zones_in(t, selection, exclude_self), None
    elif selection is not None:
        sel = list(selection)
        if direction == "both":
            t = t.where(F.col("orig").isin(sel) | F.col("dest").isin(sel))
        elif direction == "dest":
            t = t.where(F.col("dest").isin(sel))
        else:
            t = t.where(F.col("orig").isin(sel))
    if "_wt" not in t.columns:
        t = orient(t.select(*FLOW_KEYS, weight_col(linked, w, m).alias("_wt")), direction)
    if selection is not None:
        t = t.where(F.col("orig").isin(sel))
        if exclude_self:
            t = t.where(~F.coalesce(F.col("dest").isin(sel), F.lit(False)))
    g = t.groupBy(*FLOW_KEYS).agg(na_sum("_wt").alias("N"))
    g = complete(g.where(F.col("N") >= F.lit(min_n)), FLOW_KEYS + ["N"])
    # One row per zone pair: bounded by the selection times the zone count, whatever the
    # trip volume.  Written once so the quantile and the rows do not both re-scan the trips.
    return cap_at_quantile(materialize(g), "N", p, "colN")


def od_heat(flows: DataFrame, p: float = 0.95) -> DataFrame:
    """Destination roll-up of flows for a heat map, capped again, with intensity.

    The roll-up and the capped rows are written, so each is evaluated once.
    """
    h = materialize(flows.groupBy("dest").agg(F.sum("N").alias("N")))
    return intensity(materialize(cap_at_quantile(h, "N", p, "colN")), "colN")


def zone_layer(layer: DataFrame, agg: DataFrame, key: str = "dest") -> DataFrame:
    """Polygons joined with their aggregate; zones without a value are not kept."""
    a = agg.withColumnRenamed(key, "zone_id") if key != "zone_id" else agg
    return layer.drop("edges", "parts").join(a, "zone_id", "inner")


def flow_lines(flows: DataFrame, n: int = 50, explode: bool = False, orig: str | None = "orig",
               dest: str = "dest") -> DataFrame:
    """Great-circle lines for a flow table.

    Adds ``counts`` (N rounded, halves to even), ``label`` ("A to B: n", or "To B: n" for
    flows of a box, which have no ``orig``), ``line_weight`` (log2(counts) + 1; minus infinity
    for a count of 0, as log2 of 0 is) and ``vertices`` (n intermediate points plus both ends).
    ``explode=True`` returns one row per vertex instead of the array column.
    """
    counts = F.bround(F.col("N"), 0)
    out = flows.withColumns({
        "counts": counts,
        "label": flow_label(orig, dest, "N"),
        "line_weight": F.when(counts > 0, F.log2(counts) + 1).when(counts == 0, F.lit(float("-inf"))),
        "_gc": great_circle_params("orig_lon", "orig_lat", "dest_lon", "dest_lat"),
    })
    if not explode:
        return out.withColumn("vertices", great_circle_vertices("_gc", n)).drop("_gc")
    # One row per vertex: explode the index, then scalar expressions per row (no arrays).
    out = out.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(n + 1))))
    out = out.withColumn("_p", great_circle_point("_gc", "vertex", n))
    return out.withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat")}).drop("_gc", "_p")
