"""Registered O-D flow queries (Q3, Q10: A2, A3, A8, A9, U2, P14, F7, J10, G2)."""

from __future__ import annotations


from odflow.operators.flows import flow_lines, od_flows, od_heat, zone_layer
from odflow.plans import oracle as O
from odflow.plans.catalog import TRIP_COLS, layer, located_trips, register, rsql, trips
from odflow.plans.prepare import prune_to_selection, zone_trips

ZT_OUT = TRIP_COLS + ["orig", "orig_lon", "orig_lat", "dest", "dest_lon", "dest_lat"]
_ZT_SQL = f"""{O.views('trip', 'zone_edge')},
{O.zone_trips_ctes(TRIP_COLS)}
SELECT {', '.join(c if c not in ('w', 'm', 'l_extendedprice', 'orig_lon', 'orig_lat', 'dest_lon', 'dest_lat') else rsql(c) for c in ZT_OUT)}
FROM zone_trips"""


@register("zone_trips", _ZT_SQL)
def q_zone_trips(spark, sf_dir):
    """Both ends of every trip located in the zone layer, with the zones' points (Q10)."""
    return located_trips(spark, sf_dir).select(*ZT_OUT)


# Fixed parameters of the flow queries (what a user picks in the map controls).
FLOW_ROUTES = list(range(0, 16))
FLOW_PERIODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
SELECTION = [6, 7, 8, 11, 12, 13]
MIN_N = 10.005


def _flows_sql(direction: str, linked: bool, min_n: float, exclude_self: bool,
               heat: bool = False, lines: bool = False) -> str:
    wt = "w * m" if linked else "w"
    fwd = f"SELECT orig, orig_lat, orig_lon, dest, dest_lat, dest_lon, {wt} AS wt, route, time_period FROM zone_trips"
    rev = (f"SELECT dest AS orig, dest_lat AS orig_lat, dest_lon AS orig_lon, orig AS dest, "
           f"orig_lat AS dest_lat, orig_lon AS dest_lon, {wt} AS wt, route, time_period FROM zone_trips")
    oriented = {"orig": fwd, "dest": rev, "both": f"{fwd} UNION ALL {rev}"}[direction]
    sel = O.in_list(SELECTION)
    excl = f" AND NOT COALESCE(dest IN {sel}, FALSE)" if exclude_self else ""
    keys = "orig, orig_lat, orig_lon, dest, dest_lat, dest_lon"
    body = f"""{O.views('trip', 'zone_edge')},
{O.zone_trips_ctes(TRIP_COLS)},
oriented AS ({oriented}),
picked AS (SELECT * FROM oriented WHERE route IN {O.in_list(FLOW_ROUTES)}
           AND time_period IN {O.in_list(FLOW_PERIODS)} AND orig IN {sel}{excl}),
g AS (SELECT {keys}, CASE WHEN COUNT(wt) = COUNT(*) THEN SUM(wt) END AS N FROM picked GROUP BY {keys}),
f AS (SELECT * FROM g WHERE N >= {min_n} AND orig IS NOT NULL AND orig_lat IS NOT NULL
      AND orig_lon IS NOT NULL AND dest IS NOT NULL AND dest_lat IS NOT NULL AND dest_lon IS NOT NULL),
q AS (SELECT quantile_cont(N, 0.95) AS q FROM f),
flows AS (SELECT f.*, CASE WHEN N >= q THEN q ELSE N END AS colN FROM f CROSS JOIN q)"""
    if heat:
        return body + f""",
h AS (SELECT dest, SUM(N) AS N FROM flows GROUP BY dest),
hq AS (SELECT quantile_cont(N, 0.95) AS q FROM h),
hc AS (SELECT dest, N, CASE WHEN N >= q THEN q ELSE N END AS colN FROM h CROSS JOIN hq),
r AS (SELECT MIN(colN) AS lo, MAX(colN) AS hi FROM hc)
SELECT dest, {rsql('N')}, {rsql('colN')},
       {rsql('CASE WHEN hi > lo THEN (colN - lo) / (hi - lo) ELSE 0.5 END', 'intensity')}
FROM hc CROSS JOIN r"""
    if lines:
        return body + f""",
rad AS (SELECT flows.*, PI() / 180 AS k FROM flows),
geo AS (SELECT *, orig_lon * k AS l1, orig_lat * k AS f1, dest_lon * k AS l2, dest_lat * k AS f2 FROM rad),
arc AS (SELECT *, 2 * ASIN(SQRT(POWER(SIN((f2 - f1) / 2), 2) + COS(f1) * COS(f2) * POWER(SIN((l2 - l1) / 2), 2))) AS d FROM geo),
v AS (SELECT arc.*, i.vertex, CAST(i.vertex AS DOUBLE) / 51 AS fr
      FROM arc CROSS JOIN (SELECT CAST(range AS INTEGER) AS vertex FROM range(0, 52)) i),
ab AS (SELECT *, CASE WHEN SIN(d) <> 0 THEN SIN((1 - fr) * d) / SIN(d) END AS a,
              CASE WHEN SIN(d) <> 0 THEN SIN(fr * d) / SIN(d) END AS b FROM v),
xyz AS (SELECT *, a * COS(f1) * COS(l1) + b * COS(f2) * COS(l2) AS x,
               a * COS(f1) * SIN(l1) + b * COS(f2) * SIN(l2) AS y,
               a * SIN(f1) + b * SIN(f2) AS z FROM ab)
SELECT orig, dest, {rsql('N')}, vertex,
  {rsql("CASE WHEN vertex = 0 THEN orig_lon WHEN vertex = 51 THEN dest_lon WHEN SIN(d) = 0 THEN orig_lon ELSE ATAN2(y, x) / k END", 'lon')},
  {rsql("CASE WHEN vertex = 0 THEN orig_lat WHEN vertex = 51 THEN dest_lat WHEN SIN(d) = 0 THEN orig_lat ELSE ATAN2(z, SQRT(x * x + y * y)) / k END", 'lat')},
  CAST(ROUND(N, 0) AS DOUBLE) AS counts,
  CAST(orig AS VARCHAR) || ' to ' || CAST(dest AS VARCHAR) || ': ' || CAST(CAST(ROUND(N, 0) AS BIGINT) AS VARCHAR) AS label
FROM xyz"""
    return body + f"""
SELECT orig, {rsql('orig_lat')}, {rsql('orig_lon')}, dest, {rsql('dest_lat')}, {rsql('dest_lon')},
       {rsql('N')}, {rsql('colN')} FROM flows"""


def _flows(spark, sf_dir, direction, linked, min_n, exclude_self):
    lay = layer(spark, sf_dir)
    t = prune_to_selection(trips(spark, sf_dir), lay, SELECTION, direction)
    return od_flows(zone_trips(t, lay, keep=TRIP_COLS), direction=direction,
                    filters={"route": FLOW_ROUTES, "time_period": FLOW_PERIODS},
                    selection=SELECTION, linked=linked, min_n=min_n, exclude_self=exclude_self)


@register("od_flows_both", _flows_sql("both", True, MIN_N, False))
def q_od_flows_both(spark, sf_dir):
    """Flows from the selected zones in both directions, linked weights, threshold, cap."""
    return _flows(spark, sf_dir, "both", True, MIN_N, False)


@register("od_flows_orig", _flows_sql("orig", False, 0, False))
def q_od_flows_orig(spark, sf_dir):
    """Flows out of the selected zones, trip-leg weights, no threshold."""
    return _flows(spark, sf_dir, "orig", False, 0, False)


@register("od_flows_dest_exclude", _flows_sql("dest", False, 0, True))
def q_od_flows_dest_exclude(spark, sf_dir):
    """Flows into the selected zones from outside the selection (P14, F7 anti, A2)."""
    return _flows(spark, sf_dir, "dest", False, 0, True)


@register("od_heat", _flows_sql("both", True, MIN_N, False, heat=True))
def q_od_heat(spark, sf_dir):
    """Destination roll-up of the flows for a heat map, capped, with intensity."""
    return od_heat(_flows(spark, sf_dir, "both", True, MIN_N, False)) \
        .select("dest", "N", "colN", "intensity")


_ZL_SQL = _flows_sql("both", True, MIN_N, False, heat=True).rsplit("SELECT dest,", 1)[0] + f"""
SELECT zc.zone AS zone_id, {rsql('zc.cx', 'cx')}, {rsql('zc.cy', 'cy')}, {rsql('hc.N', 'N')}, {rsql('hc.colN', 'colN')}
FROM hc JOIN zc ON zc.zone = hc.dest"""


@register("zone_layer", _ZL_SQL)
def q_zone_layer(spark, sf_dir):
    """Zones joined with their heat values; zones without a value are not kept."""
    heat = od_heat(_flows(spark, sf_dir, "both", True, MIN_N, False)).select("dest", "N", "colN")
    return zone_layer(layer(spark, sf_dir), heat, key="dest") \
        .select("zone_id", "cx", "cy", "N", "colN")


@register("great_circle", _flows_sql("orig", False, 0, False, lines=True))
def q_great_circle(spark, sf_dir):
    """Great-circle flow lines, 50 intermediate vertices plus both ends, one row per vertex."""
    f = _flows(spark, sf_dir, "orig", False, 0, False)
    return flow_lines(f, n=50, explode=True).select(
        "orig", "dest", "N", "vertex", "lon", "lat", "counts", "label")
