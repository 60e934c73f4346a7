"""Registered queries of density levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.operators._broadcast import materialize
from odflow.operators.contours import bandwidths, density_levels
from odflow.plans import oracle as O
from odflow.plans.catalog import register, rsql, trips
from odflow.plans.q_other import DENS_ROUTES

_BINS = 16


def _h(axis: str) -> str:
    return (f"ROUND(1.06 * CASE WHEN QUANTILE_CONT({axis}, 0.75) > QUANTILE_CONT({axis}, 0.25) THEN LEAST(STDDEV_SAMP({axis}), "
            f"(QUANTILE_CONT({axis}, 0.75) - QUANTILE_CONT({axis}, 0.25)) / CAST(1.34 AS DOUBLE)) ELSE STDDEV_SAMP({axis}) END "
            f"* POWER(COUNT(*), CAST(-0.2 AS DOUBLE)), 9)")


_POINTS = f"""{O.views('trip')},
p AS (SELECT o_lon AS x, o_lat AS y FROM trip WHERE route IN {O.in_list(DENS_ROUTES)} AND o_lon IS NOT NULL AND o_lat IS NOT NULL),
h AS (SELECT COUNT(*) AS n, {_h('x')} AS hx, {_h('y')} AS hy FROM p)"""

# (corner the side starts at counter-clockwise, its next corner, longitude and latitude of the crossing in cells)
_SIDES = [("v0", "v1", "gx + 0.5 + (lev - v0) / (v1 - v0)", "gy + 0.5"), ("v1", "v2", "gx + 1.5", "gy + 0.5 + (lev - v1) / (v2 - v1)"),
          ("v2", "v3", "gx + 0.5 + (lev - v3) / (v2 - v3)", "gy + 1.5"), ("v3", "v0", "gx + 0.5", "gy + 0.5 + (lev - v0) / (v3 - v0)")]


def _sides(start: bool) -> str:
    a, b = (">=", "<") if start else ("<", ">=")
    return "\nUNION ALL ".join(f"SELECT bin, gx, gy, lev, saddle, high, {i} AS i, ({x}) * hx / 2 AS lon, ({y}) * hy / 2 AS lat "
                               f"FROM l, h WHERE {u} {a} lev AND {v} {b} lev" for i, (u, v, x, y) in enumerate(_SIDES))


def _origins(spark, sf_dir):
    return trips(spark, sf_dir).where(F.col("route").isin(DENS_ROUTES))


@register("density_bandwidths", f"{_POINTS}\nSELECT n, {rsql('hx')}, {rsql('hy')} FROM h")
def q_density_bandwidths(spark, sf_dir):
    """Normal-reference bandwidths of the trip origins."""
    return bandwidths(_origins(spark, sf_dir), "o_lon", "o_lat")


@register("density_levels", f"""{_POINTS},
c AS (SELECT CAST(FLOOR(x / (hx / 2)) AS BIGINT) AS gx, CAST(FLOOR(y / (hy / 2)) AS BIGINT) AS gy, COUNT(*) AS m FROM p, h GROUP BY 1, 2),
k AS (SELECT d, EXP(-d * d / CAST(8 AS DOUBLE)) AS k FROM range(-6, 7) r(d)),
d AS (SELECT c.gx + a.d AS gx, c.gy + b.d AS gy, SUM(m * a.k * b.k) / MAX(n * 2 * PI() * hx * hy) AS v FROM c, k a, k b, h GROUP BY 1, 2),
s AS (SELECT MAX(v) / {_BINS} AS step FROM d),
sq AS (SELECT DISTINCT gx - ox AS gx, gy - oy AS gy FROM d, (VALUES (0), (1)) a(ox), (VALUES (0), (1)) b(oy)),
q AS (SELECT sq.gx, sq.gy, COALESCE(d0.v, 0) AS v0, COALESCE(d1.v, 0) AS v1, COALESCE(d2.v, 0) AS v2, COALESCE(d3.v, 0) AS v3 FROM sq
  LEFT JOIN d d0 ON d0.gx = sq.gx AND d0.gy = sq.gy LEFT JOIN d d1 ON d1.gx = sq.gx + 1 AND d1.gy = sq.gy
  LEFT JOIN d d2 ON d2.gx = sq.gx + 1 AND d2.gy = sq.gy + 1 LEFT JOIN d d3 ON d3.gx = sq.gx AND d3.gy = sq.gy + 1),
l AS (SELECT *, (v0 >= lev) = (v2 >= lev) AND (v1 >= lev) = (v3 >= lev) AND (v0 >= lev) <> (v1 >= lev) AS saddle,
    (v0 + v1 + v2 + v3) / 4 >= lev AS high
  FROM (SELECT q.*, b AS bin, b * step AS lev FROM q, s, range(1, {_BINS}) r(b)) x
  WHERE LEAST(v0, v1, v2, v3) < lev AND lev <= GREATEST(v0, v1, v2, v3)),
f AS ({_sides(True)}),
t AS ({_sides(False)})
SELECT CAST(f.bin AS INTEGER) AS bin, {rsql('f.lev', 'level')}, {rsql('f.lon', 'lon')}, {rsql('f.lat', 'lat')},
  {rsql('t.lon', 'to_lon')}, {rsql('t.lat', 'to_lat')}
FROM f JOIN t ON f.bin = t.bin AND f.gx = t.gx AND f.gy = t.gy
WHERE NOT f.saddle OR t.i = (f.i + CASE WHEN f.high THEN 1 ELSE 3 END) % 4""")
def q_density_levels(spark, sf_dir):
    """Outlines of 15 density levels, each vertex with the next one on its ring."""
    rings = materialize(density_levels(_origins(spark, sf_dir), "o_lon", "o_lat", _BINS))
    after = rings.select("bin", "ring", F.pmod(F.col("vertex") - 1, F.col("size")).alias("vertex"),
                         F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    return rings.join(after, ["bin", "ring", "vertex"]).select("bin", "level", "lon", "lat", "to_lon", "to_lat")
