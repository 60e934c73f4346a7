"""Polygon layers as DataFrames.

Canonical layer schema, one row per polygon::

    zone_id, edges array<struct<x1,y1,x2,y2>>, minx, maxx, miny, maxy, cx, cy, attributes...

``(cx, cy)`` is the point used for the zone in flows (an internal point when the source has
one, else the Mercator centroid).  Building a layer groups vertices by polygon; a polygon's
vertex list is bounded by its own geometry, never by the fact data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions.geo import ring_centroid_mercator


def _edges_from_ring(ring):
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"),
        ring[(i + 1) % n]["x"].alias("x2"), ring[(i + 1) % n]["y"].alias("y2")))


def _finish(g: DataFrame, cx: str | None, cy: str | None, attrs: Sequence[str] = ()) -> DataFrame:
    bbox = g.withColumns({
        "minx": F.array_min(F.transform("edges", lambda e: F.least(e["x1"], e["x2"]))),
        "maxx": F.array_max(F.transform("edges", lambda e: F.greatest(e["x1"], e["x2"]))),
        "miny": F.array_min(F.transform("edges", lambda e: F.least(e["y1"], e["y2"]))),
        "maxy": F.array_max(F.transform("edges", lambda e: F.greatest(e["y1"], e["y2"]))),
    })
    if cx is None or cy is None:
        c = ring_centroid_mercator("edges")
        bbox = bbox.withColumns({"cx": c["lon"], "cy": c["lat"]})
    return bbox.select("zone_id", "edges", "minx", "maxx", "miny", "maxy", "cx", "cy", *attrs)


def layer_from_vertices(vertices: DataFrame, zone: str = "zone_id", seq: str = "seq",
                        x: str = "x", y: str = "y", cx: str | None = None,
                        cy: str | None = None, part: str | None = None, hole: str | None = None,
                        attrs: Sequence[str] = ()) -> DataFrame:
    """Layer from an ordered vertex table; a closing vertex equal to a ring's first is dropped.

    ``part`` numbers the rings of a polygon and ``hole`` (boolean) tells which cut a piece
    out.  Points are tested against the edges of all rings together (even-odd), which leaves
    holes out; for the centroid shells are turned one way and holes the other, so that areas
    add up with their sign.  ``attrs`` are columns of the layer, constant within a polygon;
    ``cx``/``cy`` name an internal point, where the source has one.
    """
    ring_keys = [F.col(zone).alias("zone_id"), (F.col(part) if part else F.lit(0)).alias("_part")]
    constant = [F.min(c).alias(c) for c in attrs]
    if cx is not None and cy is not None:
        constant += [F.min(cx).alias("cx"), F.min(cy).alias("cy")]
    rings = vertices.groupBy(*ring_keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("_v"),
        (F.max(hole) if hole else F.lit(False)).alias("_hole"), *constant)
    first, last = F.col("_v")[0], F.element_at("_v", -1)
    closed = (F.size("_v") > 1) & (first["x"] == last["x"]) & (first["y"] == last["y"])
    ring = F.when(closed, F.slice("_v", 1, F.size("_v") - 1)).otherwise(F.col("_v"))
    rings = rings.withColumn("_e", _edges_from_ring(ring))
    if hole is not None:
        area = F.aggregate("_e", F.lit(0.0), lambda a, e: a + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
        turned = F.transform("_e", lambda e: F.struct(e["x2"].alias("x1"), e["y2"].alias("y1"),
                                                      e["x1"].alias("x2"), e["y1"].alias("y2")))
        rings = rings.withColumn("_e", F.when((area < 0) != F.coalesce("_hole", F.lit(False)), turned).otherwise(F.col("_e")))
    names = [*attrs, *(["cx", "cy"] if cx is not None and cy is not None else [])]
    g = rings.groupBy("zone_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_e"))), lambda r: r["_e"])).alias("edges"),
        *[F.min(c).alias(c) for c in names])
    return _finish(g, cx, cy, attrs)


def layer_from_edges(edges: DataFrame, zone: str = "zone", seq: str = "seq",
                     x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2",
                     cx: str | None = "cx", cy: str | None = "cy") -> DataFrame:
    """Layer from a table with one row per polygon edge."""
    aggs = [F.array_sort(F.collect_list(F.struct(
        F.col(seq).alias("s"), F.col(x1).alias("x1"), F.col(y1).alias("y1"),
        F.col(x2).alias("x2"), F.col(y2).alias("y2")))).alias("_e")]
    if cx is not None and cy is not None:
        aggs += [F.min(cx).alias("cx"), F.min(cy).alias("cy")]
    g = edges.groupBy(F.col(zone).alias("zone_id")).agg(*aggs)
    g = g.withColumn("edges", F.transform("_e", lambda e: F.struct(
        e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"))))
    return _finish(g.drop("_e"), cx, cy)


def boxes_from_points(clicks: DataFrame, box: str = "box_id", seq: str = "seq",
                      lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Closed rings from clicked vertices, several boxes at once.

    The ring is closed by joining the last click back to the first, as the reference
    appends the first vertex.  The centroid is the Mercator centroid of the ring (G4).
    """
    return layer_from_vertices(clicks, zone=box, seq=seq, x=lon, y=lat)


def zone_centroids(layer: DataFrame) -> DataFrame:
    """Mercator centroid of every polygon of a layer (G4): ``zone_id, lon, lat``."""
    c = ring_centroid_mercator("edges")
    return layer.select("zone_id", c["lon"].alias("lon"), c["lat"].alias("lat"))
