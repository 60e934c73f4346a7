"""Spatial selections: individual trips touching zones (Q4) and custom boxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions.text import transfer_chain
from odflow.functions.weights import na_sum, weight_col
from odflow.operators._broadcast import materialize
from odflow.operators.filters import filter_in, has_point
from odflow.operators.flows import cap_at_quantile
from odflow.operators.locate import locate

def ends_by_role(trips: DataFrame, direction: str, o_lon: str = "o_lon", o_lat: str = "o_lat",
                 d_lon: str = "d_lon", d_lat: str = "d_lat", keep: Sequence[str] = ()
                 ) -> DataFrame:
    """One row per trip end that may fall in a selection: ``role`` names the near end.

    ``orig``: the origin is the near end (the far end is the destination); ``dest``: the
    reverse; ``both``: each trip gives two rows (exploded in one pass, no self-union).
    """
    def side(role, nlo, nla, flo, fla):
        return F.struct(F.lit(role).alias("role"), F.col(nlo).alias("near_lon"),
                        F.col(nla).alias("near_lat"), F.col(flo).alias("far_lon"),
                        F.col(fla).alias("far_lat"))

    sides = {"orig": [side("orig", o_lon, o_lat, d_lon, d_lat)],
             "dest": [side("dest", d_lon, d_lat, o_lon, o_lat)]}
    sides["both"] = sides["orig"] + sides["dest"]
    if direction not in sides:
        raise ValueError("direction must be 'orig', 'dest' or 'both'")
    return trips.select(*keep, F.explode(F.array(*sides[direction])).alias("_e")) \
        .select(*keep, "_e.*")


def individual_trips(trips: DataFrame, selection_layer: DataFrame, direction: str = "orig",
                     filters: Mapping[str, Sequence | None] | None = None,
                     keep: Sequence[str] = (), route: str = "route",
                     transfers_from: Sequence[str] = (), transfers_to: Sequence[str] = (),
                     o_lon: str = "o_lon", o_lat: str = "o_lat", d_lon: str = "d_lon",
                     d_lat: str = "d_lat", cell: float | None = None, how: str = "first",
                     sel: str = "sel_zone") -> DataFrame:
    """Trips with an end inside the selected polygons, with both ends.

    A trip with both ends selected in ``both`` mode appears twice, once per end.  The ends
    and attributes come from the same row, so no lookup join back to the trips is needed:
    ``lon, lat`` is the far end, ``near_lon, near_lat`` the selected one.  ``label`` is the
    transfer chain "route from1..from4 to1..to4".  Boxes are drawn on their own and may
    overlap: ``how="all"`` gives a trip once for each box (Q5).
    """
    attrs = list(dict.fromkeys([*keep, route, *transfers_from, *transfers_to]))
    t = filter_in(trips, filters)
    ends = ends_by_role(t, direction, o_lon, o_lat, d_lon, d_lat, keep=attrs)
    hit = locate(ends, selection_layer, "near_lon", "near_lat", out=sel, cell=cell, how=how)
    return hit.select(*attrs, "role", sel, F.col("far_lon").alias("lon"),
                      F.col("far_lat").alias("lat"), "near_lon", "near_lat",
                      transfer_chain(route, transfers_from, transfers_to).alias("label"))


def individual_lines(individual: DataFrame) -> DataFrame:
    """The lines of selected trips, from near to far end, one row per vertex.

    Trips whose far end is missing have no line.
    """
    ends = F.array(F.struct(F.lit(0).alias("vertex"), F.col("near_lon").alias("_x"), F.col("near_lat").alias("_y")),
                   F.struct(F.lit(1).alias("vertex"), F.col("lon").alias("_x"), F.col("lat").alias("_y")))
    rest = [c for c in individual.columns if c not in ("lon", "lat", "near_lon", "near_lat")]
    return has_point(individual, "lon", "lat").select(*rest, F.inline(ends)) \
        .withColumnsRenamed({"_x": "lon", "_y": "lat"})


def _box_ends(trips, boxes, zones, direction, linked, filters, w, m, o_lon, o_lat,
                   d_lon, d_lat, cell, box_cell):
    t = filter_in(trips, filters).select(o_lon, o_lat, d_lon, d_lat,
                                         weight_col(linked, w, m).alias("_wt"))
    ends = ends_by_role(t, direction, o_lon, o_lat, d_lon, d_lat, keep=["_wt"])
    # A near end outside the boxes' common bounding box is in no box: drop it before the
    # lookup (four comparisons in generated code).
    bb = boxes.agg(F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")).first()
    if bb[0] is None:
        ends = ends.limit(0)
    else:
        ends = ends.where(F.col("near_lon").between(bb[0], bb[1])
                          & F.col("near_lat").between(bb[2], bb[3]))
    # how="all": a point inside two overlapping boxes counts once for each box.
    near = locate(ends, boxes, "near_lon", "near_lat", out="box_id",
                  carry={"cx": "orig_lon", "cy": "orig_lat"}, how="all", cell=box_cell)
    return locate(near, zones, "far_lon", "far_lat", out="dest",
                  carry={"cx": "dest_lon", "cy": "dest_lat"}, cell=cell)


def box_flows(trips: DataFrame, boxes: DataFrame, zones: DataFrame, direction: str = "orig",
              linked: bool = False, min_n: float = 0,
              filters: Mapping[str, Sequence | None] | None = None, p: float = 0.95,
              w: str = "w", m: str = "m", o_lon: str = "o_lon", o_lat: str = "o_lat",
              d_lon: str = "d_lon", d_lat: str = "d_lat", cell: float | None = None,
              box_cell: float | None = None) -> DataFrame:
    """Flows from custom boxes to the zones of the trips' far ends.

    Trips whose near end lies in a box contribute their effective weight to the zone of
    their far end; the origin point is the box's Mercator centroid (G4).  Each box is
    independent: threshold and the 95th-percentile cap are applied per box.
    """
    far = _box_ends(trips, boxes, zones, direction, linked, filters, w, m, o_lon, o_lat,
                    d_lon, d_lat, cell, box_cell)
    g = far.groupBy("box_id", "orig_lon", "orig_lat", "dest", "dest_lon", "dest_lat") \
        .agg(na_sum("_wt").alias("N")).where(F.col("N") >= F.lit(min_n))
    return cap_at_quantile(materialize(g), "N", p, "colN", by=["box_id"])


def box_heat(trips: DataFrame, boxes: DataFrame, zones: DataFrame, direction: str = "orig",
             linked: bool = False, min_n: float = 0,
             filters: Mapping[str, Sequence | None] | None = None, p: float = 0.95,
             w: str = "w", m: str = "m", o_lon: str = "o_lon", o_lat: str = "o_lat",
             d_lon: str = "d_lon", d_lat: str = "d_lat", cell: float | None = None,
             box_cell: float | None = None) -> DataFrame:
    """Heat by zone over the trip ends of all boxes drawn (A11, U3); threshold after the merge.

    The ends of all boxes are stacked and summed once, as when the map is redrawn: a missing
    weight in any box makes the zone's sum missing, and the threshold drops it.
    """
    far = _box_ends(trips, boxes, zones, direction, linked, filters, w, m, o_lon, o_lat,
                    d_lon, d_lat, cell, box_cell)
    h = far.groupBy("dest", "dest_lon", "dest_lat").agg(na_sum("_wt").alias("N")) \
        .where(F.col("N") >= F.lit(min_n))
    return cap_at_quantile(materialize(h), "N", p, "colN")
