"""Point densities (A13, A14, A15): unweighted counts of trip points on a regular grid.

The browser-side blur of the reference is replaced by the cell counts it blurs; the optional
smoothing spreads each cell's count to its neighbours with Gaussian weights (A15).  All are
hash aggregates on the cell pair with map-side partial aggregation, so a hot cell holding
a third of the points is pre-aggregated in every task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators.filters import has_point

def by_role(trips: DataFrame, roles: Mapping[str, tuple[str, str]], keep: Sequence[str] = (),
            pick: Sequence[str] | None = None) -> DataFrame:
    """One row per trip and point role (home, origin, boarding, ...): ``keep, role, lon, lat``.

    ``roles`` maps a role to its (lon, lat) columns; ``pick`` limits the roles.  All roles are
    read in one pass.
    """
    each = [F.struct(F.lit(r).alias("role"), F.col(lo).alias("lon"), F.col(la).alias("lat"))
            for r, (lo, la) in roles.items() if pick is None or r in pick]
    return trips.select(*keep, F.inline(F.array(*each)))


def point_listing(trips: DataFrame, lon: str, lat: str, keep: Sequence[str], routes: Sequence | None = None,
                  route_col: str = "route") -> DataFrame:
    """The points themselves, unclustered, with attributes for their popups."""
    t = trips if routes is None or "All" in routes else trips.where(F.col(route_col).isin(list(routes)))
    return has_point(t, lon, lat).select(*keep, F.col(lon).alias("lon"), F.col(lat).alias("lat"))


def _cells(trips, lon, lat, routes, route_col, cell):
    t = trips
    if routes is not None and "All" not in routes:
        t = t.where(F.col(route_col).isin(list(routes)))
    t = has_point(t, lon, lat)
    return t.withColumns({"gx": F.floor(F.col(lon) / F.lit(cell)),
                          "gy": F.floor(F.col(lat) / F.lit(cell))})


def point_density(trips: DataFrame, lon: str, lat: str, routes: Sequence | None = None,
                  cell: float = 0.01, route_col: str = "route", by: Sequence[str] = ()) -> DataFrame:
    """Count of points per grid cell (A13): ``gx, gy, n``, for each value of ``by`` if given."""
    return _cells(trips, lon, lat, routes, route_col, cell).groupBy(*by, "gx", "gy") \
        .agg(F.count(F.lit(1)).alias("n"))


def point_clusters(trips: DataFrame, lon: str, lat: str, routes: Sequence | None = None,
                   cell: float = 0.01, route_col: str = "route") -> DataFrame:
    """Clustered point listing (A14): count and mean position of the points of each cell."""
    return _cells(trips, lon, lat, routes, route_col, cell).groupBy("gx", "gy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))


def smoothed_density(trips: DataFrame, lon: str, lat: str, routes: Sequence | None = None,
                     cell: float = 0.01, radius: int = 2, bandwidth: float = 1.0,
                     route_col: str = "route") -> DataFrame:
    """Gaussian-smoothed cell density (A15): ``gx, gy, density``.

    Each occupied cell sends ``n * exp(-(dx^2 + dy^2) / (2 h^2))`` to the cells within
    ``radius`` (h = ``bandwidth`` in cells); the weights are normalised to sum to one.
    The spread happens after the counts, so its size is cells x (2r+1)^2, not points.
    """
    counts = point_density(trips, lon, lat, routes, cell, route_col)
    offs = range(-radius, radius + 1)
    raw = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * bandwidth * bandwidth))
           for dx in offs for dy in offs}
    norm = sum(raw.values())
    kernel = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"),
                                F.lit(v / norm).alias("k")) for (dx, dy), v in raw.items()])
    spread = counts.select("gx", "gy", "n", F.explode(kernel).alias("_k")).select(
        (F.col("gx") + F.col("_k.dx")).alias("gx"), (F.col("gy") + F.col("_k.dy")).alias("gy"),
        (F.col("n") * F.col("_k.k")).alias("w"))
    return spread.groupBy("gx", "gy").agg(F.sum("w").alias("density"))


def cluster_pyramid(points: DataFrame, lon: str, lat: str, zooms: tuple[int, int], routes: Sequence | None = None,
                    route_col: str = "route") -> DataFrame:
    """Clusters of every zoom of a range from one pass over the points.

    Zoom z divides 360 x 360 degrees into 2^z x 2^z cells, so a cell's four parts are the cells
    of the next zoom.  Points are counted and summed once, in the finest cells; every coarser
    zoom is rolled up from those, by the digits of the cell numbers.  Rows: ``zoom, gx, gy`` with
    the cluster they open into one zoom out (``parent_gx, parent_gy``; null at the first zoom),
    the count ``n`` and the mean point ``lon, lat``.  Counts and sums merge exactly by zoom, and
    a crowded cell is combined in every task before the shuffle.
    """
    low, high = zooms
    t = points if routes is None or "All" in routes else points.where(F.col(route_col).isin(list(routes)))
    cell = 360.0 / (1 << high)
    finest = has_point(t, lon, lat).groupBy(
        F.floor((F.col(lon) + 180.0) / F.lit(cell)).alias("gx"), F.floor((F.col(lat) + 180.0) / F.lit(cell)).alias("gy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(lon).alias("sx"), F.sum(lat).alias("sy"))
    every = finest.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("zoom")).select(
        "zoom", F.expr(f"shiftright(gx, {high} - zoom)").alias("gx"), F.expr(f"shiftright(gy, {high} - zoom)").alias("gy"), "n", "sx", "sy")
    g = every.groupBy("zoom", "gx", "gy").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")])
    up = lambda c: F.when(F.col("zoom") > low, F.shiftright(c, 1))
    return g.select("zoom", "gx", "gy", up("gx").alias("parent_gx"), up("gy").alias("parent_gy"), "n",
                    (F.col("sx") / F.col("n")).alias("lon"), (F.col("sy") / F.col("n")).alias("lat"))
