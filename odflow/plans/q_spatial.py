"""Registered spatial queries (J8, J9, Q2, Q4, Q5: G1, G3, G4, A6, A11, U3, J11, P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.operators.geometry_layer import boxes_from_points
from odflow.functions.text import transfer_chain
from odflow.operators.lines import route_map, trip_lines
from odflow.operators.locate import locate, occupied_zones
from odflow.operators.selection import box_flows, box_heat, individual_trips
from odflow.operators.filters import filter_in
from odflow.plans import oracle as O
from odflow.plans.catalog import layer, register, rsql, trips
from odflow.plans.q_flows import SELECTION

KEY = O.TRIP_KEY
KEY_SQL = ", ".join(f"t.{k}" if k != "l_extendedprice" else rsql("t.l_extendedprice", "l_extendedprice")
                    for k in KEY)


@register("locate_points", f"""{O.views('trip', 'zone_edge')},
{O.point_zone_cte('o_in', 'trip', 'o_lon', 'o_lat')}
SELECT {KEY_SQL}, {rsql('t.o_lon', 'o_lon')}, {rsql('t.o_lat', 'o_lat')}, o.zone AS zone_id
FROM trip t JOIN o_in o ON o.lon = t.o_lon AND o.lat = t.o_lat""")
def q_locate_points(spark, sf_dir):
    """Zone of every trip origin by the grid-indexed point-in-polygon join; unmatched dropped."""
    t = trips(spark, sf_dir).select(*KEY, "o_lon", "o_lat")
    return locate(t, layer(spark, sf_dir), "o_lon", "o_lat")


@register("occupied_zones", f"""{O.views('trip', 'zone_edge')},
zc AS (SELECT zone, MIN(cx) AS cx, MIN(cy) AS cy FROM zone_edge GROUP BY zone),
pts AS (SELECT o_lon AS lon, o_lat AS lat FROM trip UNION ALL SELECT d_lon, d_lat FROM trip),
{O.point_zone_cte('loc', 'pts', 'lon', 'lat')}
SELECT zone AS zone_id, {rsql('cx')}, {rsql('cy')} FROM zc WHERE zone IN (SELECT zone FROM loc)""")
def q_occupied_zones(spark, sf_dir):
    """Zones holding at least one trip end, origins and destinations together."""
    t = trips(spark, sf_dir)
    return occupied_zones(layer(spark, sf_dir), t, [("o_lon", "o_lat"), ("d_lon", "d_lat")]) \
        .select("zone_id", "cx", "cy")


IND_FILTERS = {"route": list(range(0, 10))}


def _ind_sql() -> str:
    rt = O.in_list(IND_FILTERS["route"])
    label = "CAST(t.route AS VARCHAR) || ' ' || COALESCE(t.flag, '') || ' ' || COALESCE(t.segment, '')"
    part = lambda role, nlo, nla, flo, fla, cte: (
        f"SELECT {KEY_SQL}, t.route, t.time_period, t.flag, t.segment, '{role}' AS role, "
        f"n.zone AS sel_zone, {rsql('t.' + flo, 'lon')}, {rsql('t.' + fla, 'lat')}, {label} AS label "
        f"FROM tf t JOIN {cte} n ON n.lon = t.{nlo} AND n.lat = t.{nla}")
    return f"""{O.views('trip', 'zone_edge')},
sel_edge AS (SELECT * FROM zone_edge WHERE zone IN {O.in_list(SELECTION)}),
tf AS (SELECT * FROM trip WHERE route IN {rt}),
{O.point_zone_cte('near_o', 'tf', 'o_lon', 'o_lat', 'sel_edge')},
{O.point_zone_cte('near_d', 'tf', 'd_lon', 'd_lat', 'sel_edge')}
{part('orig', 'o_lon', 'o_lat', 'd_lon', 'd_lat', 'near_o')}
UNION ALL
{part('dest', 'd_lon', 'd_lat', 'o_lon', 'o_lat', 'near_d')}"""


@register("individual_trips", _ind_sql())
def q_individual_trips(spark, sf_dir):
    """Trips with an end in the selected zones, both directions, far end and label."""
    sel = layer(spark, sf_dir).where(F.col("zone_id").isin(SELECTION))
    return individual_trips(trips(spark, sf_dir), sel, direction="both", filters=IND_FILTERS,
                            keep=[*KEY, "time_period"], route="route",
                            transfers_from=["flag"], transfers_to=["segment"]) \
        .select(*KEY, "route", "time_period", "flag", "segment", "role", "sel_zone", "lon",
                "lat", "label")


# Fixed parameters: clicked vertices of three custom boxes (two overlap).
BOXES = {
    1: [(-93.45, 44.80), (-93.25, 44.80), (-93.25, 44.95), (-93.45, 44.95)],
    2: [(-93.35, 44.90), (-93.10, 44.88), (-93.12, 45.05), (-93.33, 45.02)],
    3: [(-93.00, 45.00), (-92.85, 45.00), (-92.90, 45.12)],
}
BOX_FILTERS = {"route": list(range(0, 15))}


def _boxes(spark):
    rows = [(b, i, lon, lat) for b, pts in BOXES.items() for i, (lon, lat) in enumerate(pts)]
    clicks = spark.createDataFrame(rows, "box_id int, seq int, lon double, lat double")
    return boxes_from_points(clicks)


def _box_edges_sql() -> str:
    rows = []
    for b, pts in BOXES.items():
        for i, (x1, y1) in enumerate(pts):
            x2, y2 = pts[(i + 1) % len(pts)]
            rows.append(f"({b}, {i}, CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), "
                        f"CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))")
    return ("box_edge AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") v(zone, seq, x1, y1, x2, y2))")


def _box_sql(direction: str, linked: bool, heat: bool, min_n: float) -> str:
    wt = "t.w * t.m" if linked else "t.w"
    merc = "LN(TAN(PI() / 4 + {} * PI() / 360))"
    my1, my2 = merc.format("y1"), merc.format("y2")
    cr = f"(x1 * {my2} - x2 * {my1})"
    parts = []
    if direction in ("orig", "both"):
        parts.append(f"SELECT b.zone AS box_id, t.d_lon AS flon, t.d_lat AS flat, {wt} AS wt "
                     f"FROM tf t JOIN near_o b ON b.lon = t.o_lon AND b.lat = t.o_lat")
    if direction in ("dest", "both"):
        parts.append(f"SELECT b.zone AS box_id, t.o_lon AS flon, t.o_lat AS flat, {wt} AS wt "
                     f"FROM tf t JOIN near_d b ON b.lon = t.d_lon AND b.lat = t.d_lat")
    body = f"""{O.views('trip', 'zone_edge')},
{_box_edges_sql()},
zc AS (SELECT zone, MIN(cx) AS cx, MIN(cy) AS cy FROM zone_edge GROUP BY zone),
bc AS (SELECT zone AS box_id, SUM((x1 + x2) * {cr}) / (3 * SUM({cr})) AS orig_lon,
       (ATAN(EXP(SUM(({my1} + {my2}) * {cr}) / (3 * SUM({cr})))) * 2 - PI() / 2) * (180 / PI()) AS orig_lat
       FROM box_edge GROUP BY zone),
tf AS (SELECT * FROM trip WHERE route IN {O.in_list(BOX_FILTERS['route'])}),
{O.point_zone_cte('near_o', 'tf', 'o_lon', 'o_lat', 'box_edge', how='all')},
{O.point_zone_cte('near_d', 'tf', 'd_lon', 'd_lat', 'box_edge', how='all')},
ends AS ({' UNION ALL '.join(parts)}),
{O.point_zone_cte('far', 'ends', 'flon', 'flat')},
g AS (SELECT e.box_id, f.zone AS dest, zc.cx AS dest_lon, zc.cy AS dest_lat,
             CASE WHEN COUNT(e.wt) = COUNT(*) THEN SUM(e.wt) END AS N
      FROM ends e JOIN far f ON f.lon = e.flon AND f.lat = e.flat JOIN zc ON zc.zone = f.zone
      GROUP BY e.box_id, f.zone, zc.cx, zc.cy),
gn AS (SELECT * FROM g WHERE N IS NOT NULL)"""
    if heat:
        # All boxes' trip ends stacked, then one sum: a missing weight removes the zone.
        return body + f""",
s AS (SELECT f.zone AS dest, zc.cx AS dest_lon, zc.cy AS dest_lat, COUNT(*) AS ends, COUNT(e.wt) AS weighted, SUM(e.wt) AS N
      FROM ends e JOIN far f ON f.lon = e.flon AND f.lat = e.flat JOIN zc ON zc.zone = f.zone GROUP BY f.zone, zc.cx, zc.cy),
h AS (SELECT dest, dest_lon, dest_lat, N FROM s WHERE ends = weighted AND N >= {min_n}),
q AS (SELECT quantile_cont(N, 0.95) AS q FROM h)
SELECT dest, {rsql('dest_lon')}, {rsql('dest_lat')}, {rsql('N')},
       {rsql('CASE WHEN N >= q THEN q ELSE N END', 'colN')} FROM h CROSS JOIN q"""
    return body + f""",
f AS (SELECT * FROM gn WHERE N >= {min_n}),
q AS (SELECT box_id, quantile_cont(N, 0.95) AS q FROM f GROUP BY box_id)
SELECT f.box_id, {rsql('bc.orig_lon', 'orig_lon')}, {rsql('bc.orig_lat', 'orig_lat')}, dest,
       {rsql('dest_lon')}, {rsql('dest_lat')}, {rsql('N')},
       {rsql('CASE WHEN N >= q THEN q ELSE N END', 'colN')}
FROM f JOIN q ON q.box_id = f.box_id JOIN bc ON bc.box_id = f.box_id"""


@register("box_flows", _box_sql("both", True, False, 0))
def q_box_flows(spark, sf_dir):
    """Flows from three custom boxes (two overlapping) to far-end zones, capped per box."""
    return box_flows(trips(spark, sf_dir), _boxes(spark), layer(spark, sf_dir),
                     direction="both", linked=True, min_n=0, filters=BOX_FILTERS).select(
        "box_id", "orig_lon", "orig_lat", "dest", "dest_lon", "dest_lat", "N", "colN")


@register("box_heat", _box_sql("orig", False, True, 20.005))
def q_box_heat(spark, sf_dir):
    """Heat by far-end zone summed over all boxes, threshold after the merge, capped."""
    return box_heat(trips(spark, sf_dir), _boxes(spark), layer(spark, sf_dir),
                    direction="orig", linked=False, min_n=20.005, filters=BOX_FILTERS).select(
        "dest", "dest_lon", "dest_lat", "N", "colN")


RL_FILTERS = {"route": [2, 3, 5, 7], "time_period": ["1-URGENT", "3-MEDIUM"]}


@register("route_lines", f"""{O.views('trip')},
tf AS (SELECT * FROM trip WHERE route IN {O.in_list(RL_FILTERS['route'])}
       AND time_period IN {O.in_list(RL_FILTERS['time_period'])}
       AND o_lon IS NOT NULL AND o_lat IS NOT NULL AND d_lon IS NOT NULL AND d_lat IS NOT NULL)
SELECT {KEY_SQL}, 0 AS vertex, {rsql('t.o_lon', 'lon')}, {rsql('t.o_lat', 'lat')} FROM tf t
UNION ALL
SELECT {KEY_SQL}, 1 AS vertex, {rsql('t.d_lon', 'lon')}, {rsql('t.d_lat', 'lat')} FROM tf t""")
def q_route_lines(spark, sf_dir):
    """Origin-destination lines of the trips matching demographic filters, vertices exploded (Q2, G1)."""
    t = filter_in(trips(spark, sf_dir), RL_FILTERS)
    return trip_lines(t, KEY, which="od", explode=True)


@register("box_flows_dest", _box_sql("dest", False, False, 15.005))
def q_box_flows_dest(spark, sf_dir):
    """Flows into custom boxes from the zones of the trips' origins, thresholded."""
    return box_flows(trips(spark, sf_dir), _boxes(spark), layer(spark, sf_dir),
                     direction="dest", linked=False, min_n=15.005, filters=BOX_FILTERS).select(
        "box_id", "orig_lon", "orig_lat", "dest", "dest_lon", "dest_lat", "N", "colN")


def _ind_orig_sql() -> str:
    full = _ind_sql()
    return full.split("\nUNION ALL\n")[0]


@register("individual_trips_orig", _ind_orig_sql())
def q_individual_trips_orig(spark, sf_dir):
    """Trips starting in the selected zones with their destinations (Q4, origin mode)."""
    sel = layer(spark, sf_dir).where(F.col("zone_id").isin(SELECTION))
    return individual_trips(trips(spark, sf_dir), sel, direction="orig", filters=IND_FILTERS,
                            keep=[*KEY, "time_period"], route="route",
                            transfers_from=["flag"], transfers_to=["segment"]) \
        .select(*KEY, "route", "time_period", "flag", "segment", "role", "sel_zone", "lon",
                "lat", "label")


@register("route_end_points", f"""{O.views('trip')},
tf AS (SELECT * FROM trip WHERE route IN {O.in_list(RL_FILTERS['route'])}
       AND time_period IN {O.in_list(RL_FILTERS['time_period'])}
       AND d_lon IS NOT NULL AND d_lat IS NOT NULL)
SELECT {KEY_SQL}, t.route, t.time_period, {rsql('t.d_lon', 'lon')}, {rsql('t.d_lat', 'lat')},
       CAST(t.route AS VARCHAR) || ' ' || COALESCE(t.flag, '') || ' ' || COALESCE(t.segment, '') AS label
FROM tf t""")
def q_route_end_points(spark, sf_dir):
    """End points of the route-map trips with their transfer-chain label."""
    t = filter_in(trips(spark, sf_dir), RL_FILTERS)
    _, ends = route_map(t, KEY, attrs=["route", "time_period"],
                        label=transfer_chain("route", ["flag"], ["segment"]))
    return ends
