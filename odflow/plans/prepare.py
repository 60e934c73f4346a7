"""Preparation plans (Q9, Q10): raw survey rows to prepared fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from odflow.operators.locate import LayerIndex, cell_index, locate


def zone_trips(trips: DataFrame, layer: DataFrame, o_lon: str = "o_lon", o_lat: str = "o_lat",
               d_lon: str = "d_lon", d_lat: str = "d_lat", keep: Sequence[str] | None = None,
               index: LayerIndex | None = None) -> DataFrame:
    """Locate both ends of every trip in a zone layer (Q10 = J8 twice + J7).

    Output: ``keep`` columns plus ``orig, orig_lon, orig_lat, dest, dest_lon, dest_lat`` where
    the points are the zones' points (``cx``, ``cy`` of the layer) carried by the lookup
    itself, so no separate centroid join is needed.  Ends outside every zone keep NULLs.
    Both lookups probe the same written index (``index``, where the caller has one of the
    layer with ``cx`` and ``cy``).
    """
    t = trips if keep is None else trips.select(*dict.fromkeys([*keep, o_lon, o_lat, d_lon, d_lat]))
    index = index or cell_index(layer, carry=["cx", "cy"])  # probed twice
    t = locate(t, layer, o_lon, o_lat, out="orig", carry={"cx": "orig_lon", "cy": "orig_lat"},
               keep_unmatched=True, index=index, spread=[d_lon, d_lat])
    t = locate(t, layer, d_lon, d_lat, out="dest", carry={"cx": "dest_lon", "cy": "dest_lat"},
               keep_unmatched=True, index=index, spread=[o_lon, o_lat])
    if keep is not None:
        drop = [c for c in (o_lon, o_lat, d_lon, d_lat) if c not in keep]
        t = t.drop(*drop)
    return t


def selection_box(layer: DataFrame, selection: Sequence) -> tuple[float, float, float, float] | None:
    """Bounding box (minx, maxx, miny, maxy) of the selected zones; None when none exist."""
    from pyspark.sql import functions as F
    r = layer.where(F.col("zone_id").isin(list(selection))).agg(
        F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")).first()
    return None if r[0] is None else (r[0], r[1], r[2], r[3])


def prune_to_selection(trips: DataFrame, layer: DataFrame, selection: Sequence,
                       direction: str, o_lon: str = "o_lon", o_lat: str = "o_lat",
                       d_lon: str = "d_lon", d_lat: str = "d_lat") -> DataFrame:
    """Drop trips whose selected-side end lies outside the selected zones' bounding box.

    Such a trip cannot have that end in the selection, so flows from the selection are
    unchanged; the test is four comparisons in generated code and runs before any ring
    test, which a filter on the located zone id could not be pushed below.
    """
    from pyspark.sql import functions as F
    box = selection_box(layer, selection)
    if box is None:
        return trips.limit(0)
    x0, x1, y0, y1 = box

    def inside(lo, la):
        return F.col(lo).between(x0, x1) & F.col(la).between(y0, y1)

    cond = {"orig": inside(o_lon, o_lat), "dest": inside(d_lon, d_lat),
            "both": inside(o_lon, o_lat) | inside(d_lon, d_lat)}[direction]
    return trips.where(cond)
