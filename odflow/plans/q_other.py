"""Registered panel, density, cleaning and lookup queries (Q6, Q8, Q9 parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions.text import concat_parts, first_token, remap, to_number
from odflow.operators.clean import assign_rules, blank_to_null
from odflow.operators.density import point_clusters, point_density, smoothed_density
from odflow.operators.filters import exclude_ids
from odflow.operators.joins import attach_route_type, attach_weights
from odflow.operators.lines import trip_ends
from odflow.operators.panel import panel_flows, panel_heat
from odflow.plans import oracle as O
from odflow.plans.catalog import layer, register, rsql, trips
from odflow.sources import views as V
from odflow.sources.views import driver_table

# ----------------------------------------------------------------------------- panel
PF = {"parts": ["0", "2"], "day_type": "weekday", "direction": "both", "selection": [3, 4, 5]}
PH = {"parts": ["1", "2", "3"], "day_type": "weekend", "direction": "dest",
      "selection": [10, 11], "exclude_self": True}
ZC = "zc AS (SELECT zone, MIN(cx) AS cx, MIN(cy) AS cy FROM zone_edge GROUP BY zone)"


def _panel_base(parts, day_type) -> str:
    parts = ["0"] if "0" in parts else parts
    return (f"p AS (SELECT o_zone AS orig, d_zone AS dest, idx FROM panel_od "
            f"WHERE day_part IN {O.in_list(parts)} AND day_type = '{day_type}')")


@register("panel_flows", f"""{O.views('panel_od', 'zone_edge')}, {ZC},
{_panel_base(PF['parts'], PF['day_type'])},
pc AS (SELECT p.*, zo.cx AS orig_lon, zo.cy AS orig_lat, zd.cx AS dest_lon, zd.cy AS dest_lat
       FROM p LEFT JOIN zc zo ON zo.zone = p.orig LEFT JOIN zc zd ON zd.zone = p.dest),
o AS (SELECT orig, orig_lat, orig_lon, dest, dest_lat, dest_lon, idx FROM pc UNION ALL
      SELECT dest, dest_lat, dest_lon, orig, orig_lat, orig_lon, idx FROM pc),
g AS (SELECT orig, orig_lat, orig_lon, dest, dest_lat, dest_lon, COALESCE(SUM(idx), 0) AS N FROM o
      WHERE orig IN {O.in_list(PF['selection'])} GROUP BY orig, orig_lat, orig_lon, dest, dest_lat, dest_lon)
SELECT orig, {rsql('orig_lat')}, {rsql('orig_lon')}, dest, {rsql('dest_lat')}, {rsql('dest_lon')},
       {rsql('N')}, {rsql('N', 'colN')} FROM g""")
def q_panel_flows(spark, sf_dir):
    """Panel O-D index flows, all-day part only when requested, both directions."""
    return panel_flows(V.panel_od(spark, sf_dir), layer(spark, sf_dir), PF["parts"],
                       PF["day_type"], direction=PF["direction"], selection=PF["selection"])


@register("panel_heat", f"""{O.views('panel_od', 'zone_edge')}, {ZC},
{_panel_base(PH['parts'], PH['day_type'])},
o AS (SELECT dest AS orig, orig AS dest, idx FROM p),
h AS (SELECT dest, COALESCE(SUM(idx), 0) AS N FROM o WHERE orig IN {O.in_list(PH['selection'])}
      AND NOT COALESCE(dest IN {O.in_list(PH['selection'])}, FALSE) GROUP BY dest),
j AS (SELECT zc.zone AS zone_id, zc.cx, zc.cy, h.N FROM h JOIN zc ON zc.zone = h.dest),
r AS (SELECT MIN(N) AS lo, MAX(N) AS hi FROM j)
SELECT zone_id, {rsql('cx')}, {rsql('cy')}, {rsql('N')},
       {rsql('CASE WHEN hi > lo THEN (N - lo) / (hi - lo) ELSE 0.5 END', 'intensity')} FROM j CROSS JOIN r""")
def q_panel_heat(spark, sf_dir):
    """Panel index per destination zone, selection excluded, with intensity."""
    return panel_heat(V.panel_od(spark, sf_dir), layer(spark, sf_dir), PH["parts"],
                      PH["day_type"], direction=PH["direction"], selection=PH["selection"],
                      exclude_self=PH["exclude_self"]).select("zone_id", "cx", "cy", "N",
                                                              "intensity")


PH2 = {"parts": ["3"], "day_type": "weekday", "direction": "both", "selection": [0, 1, 2, 7]}


@register("panel_heat_both", f"""{O.views('panel_od', 'zone_edge')}, {ZC},
{_panel_base(PH2['parts'], PH2['day_type'])},
o AS (SELECT orig, dest, idx FROM p UNION ALL SELECT dest, orig, idx FROM p),
h AS (SELECT dest, COALESCE(SUM(idx), 0) AS N FROM o WHERE orig IN {O.in_list(PH2['selection'])} GROUP BY dest),
j AS (SELECT zc.zone AS zone_id, zc.cx, zc.cy, h.N FROM h JOIN zc ON zc.zone = h.dest),
r AS (SELECT MIN(N) AS lo, MAX(N) AS hi FROM j)
SELECT zone_id, {rsql('cx')}, {rsql('cy')}, {rsql('N')},
       {rsql('CASE WHEN hi > lo THEN (N - lo) / (hi - lo) ELSE 0.5 END', 'intensity')} FROM j CROSS JOIN r""")
def q_panel_heat_both(spark, sf_dir):
    """Panel index heat for both directions of the selection, evening part."""
    return panel_heat(V.panel_od(spark, sf_dir), layer(spark, sf_dir), PH2["parts"],
                      PH2["day_type"], direction=PH2["direction"],
                      selection=PH2["selection"]).select("zone_id", "cx", "cy", "N", "intensity")


# ----------------------------------------------------------------------------- density
DENS_ROUTES = [1, 4, 9, 16]
CELL = 0.02


def _cell_sql(lon, lat):
    return (f"CAST(FLOOR({lon} / CAST({CELL} AS DOUBLE)) AS BIGINT) AS gx, "
            f"CAST(FLOOR({lat} / CAST({CELL} AS DOUBLE)) AS BIGINT) AS gy")


@register("point_density", f"""{O.views('trip')}
SELECT gx, gy, COUNT(*) AS n FROM (SELECT {_cell_sql('d_lon', 'd_lat')} FROM trip
  WHERE route IN {O.in_list(DENS_ROUTES)} AND d_lon IS NOT NULL AND d_lat IS NOT NULL) c
GROUP BY gx, gy""")
def q_point_density(spark, sf_dir):
    """Unweighted destination density per grid cell for selected routes."""
    return point_density(trips(spark, sf_dir), "d_lon", "d_lat", routes=DENS_ROUTES, cell=CELL)


@register("point_clusters", f"""{O.views('trip')}
SELECT gx, gy, COUNT(*) AS n, {rsql('AVG(o_lon)', 'lon')}, {rsql('AVG(o_lat)', 'lat')} FROM (
  SELECT {_cell_sql('o_lon', 'o_lat')}, o_lon, o_lat FROM trip
  WHERE o_lon IS NOT NULL AND o_lat IS NOT NULL) c GROUP BY gx, gy""")
def q_point_clusters(spark, sf_dir):
    """Origins clustered per grid cell: count and mean position, all routes."""
    return point_clusters(trips(spark, sf_dir), "o_lon", "o_lat", routes=["All"], cell=CELL)


def _kernel_sql(radius=2, h=1.0):
    import math
    raw = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * h * h))
           for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)}
    s = sum(raw.values())
    rows = ", ".join(f"({dx}, {dy}, CAST({v / s!r} AS DOUBLE))" for (dx, dy), v in raw.items())
    return f"k AS (SELECT * FROM (VALUES {rows}) v(dx, dy, k))"


@register("smoothed_density", f"""{O.views('trip')}, {_kernel_sql()},
c AS (SELECT gx, gy, COUNT(*) AS n FROM (SELECT {_cell_sql('o_lon', 'o_lat')} FROM trip
      WHERE route IN {O.in_list(DENS_ROUTES)} AND o_lon IS NOT NULL AND o_lat IS NOT NULL) x GROUP BY gx, gy)
SELECT c.gx + k.dx AS gx, c.gy + k.dy AS gy, {rsql('SUM(c.n * k.k)', 'density')}
FROM c CROSS JOIN k GROUP BY c.gx + k.dx, c.gy + k.dy""")
def q_smoothed_density(spark, sf_dir):
    """Gaussian-smoothed origin density on the grid, kernel radius 2 cells."""
    return smoothed_density(trips(spark, sf_dir), "o_lon", "o_lat", routes=DENS_ROUTES,
                            cell=CELL, radius=2, bandwidth=1.0)


# ----------------------------------------------------------------------------- cleaning
SEG_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "MACHINERY": 4}


@register("clean_customers", """SELECT c_custkey,
  COALESCE(c_name, '') || ' ' || COALESCE(c_mktsegment, '') || ' ' || COALESCE(CAST(c_nationkey AS VARCHAR), '') AS address,
  COALESCE(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
           WHEN 'MACHINERY' THEN 4 END, -1) AS seg_code,
  TRY_CAST(REPLACE(c_name, 'Customer#', '') AS DOUBLE) AS cust_no
FROM customer WHERE NOT COALESCE(c_name LIKE '%7%', FALSE)""")
def q_clean_customers(spark, sf_dir):
    """Address parts joined, segment remapped to codes, tolerant number cast, ids with a 7
    excluded (P1, P4, P5, P7, P13)."""
    c = exclude_ids(driver_table(spark, sf_dir, "customer"), "c_name", "7")
    return c.select("c_custkey",
                    concat_parts(["c_name", "c_mktsegment", "c_nationkey"]).alias("address"),
                    remap("c_mktsegment", SEG_CODES, default=-1).alias("seg_code"),
                    to_number(F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("")))
                    .alias("cust_no"))


@register("clean_parts", """SELECT p_partkey,
  REGEXP_REPLACE(p_name, ' .*', '') AS first_word,
  TRY_CAST(REPLACE(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no,
  TRY_CAST(p_type AS DOUBLE) AS type_no,
  CASE WHEN p_size < 5 THEN 'S' WHEN p_size > 40 THEN 'L' WHEN p_size > 10 THEN 'M' END AS size_class,
  NULLIF(CASE WHEN p_name LIKE 'small%' THEN '' ELSE p_name END, '') AS big_name
FROM part""")
def q_clean_parts(spark, sf_dir):
    """First token, stripped and tolerant casts, last-rule-wins classes, blanks to null
    (P2, P3, P4, P7, P10)."""
    p = driver_table(spark, sf_dir, "part")
    p = p.withColumn("big_name", F.when(F.col("p_name").startswith("small"), F.lit(""))
                     .otherwise(F.col("p_name")))
    p = assign_rules(p, "size_class", [(F.col("p_size") > 10, "M"), (F.col("p_size") > 40, "L"),
                                       (F.col("p_size") < 5, "S")])
    p = blank_to_null(p, ["big_name"])
    return p.select("p_partkey", first_token("p_name").alias("first_word"),
                    to_number(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")))
                    .alias("brand_no"),
                    to_number("p_type").alias("type_no"), "size_class", "big_name")


@register("weights_lookup", f"""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  {rsql('o.o_totalprice', 'w')} FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def q_weights_lookup(spark, sf_dir):
    """Survey weights attached to every record by a left lookup on the record id."""
    li = driver_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ID"), "l_linenumber", "l_partkey")
    wt = driver_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"),
                                                      F.col("o_totalprice").alias("w"))
    return attach_weights(li, wt, "ID").withColumnRenamed("ID", "l_orderkey")


_RT_TEXT = ("CASE WHEN l_returnflag = 'R' THEN 'COAST ' || l_linestatus "
            "ELSE CAST(l_suppkey AS VARCHAR) || ' ' || l_linestatus END")


@register("route_type_lookup", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey,
  regexp_replace({_RT_TEXT}, ' .*', '') AS route FROM lineitem)
SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.route,
  CASE WHEN t.route = '12' THEN 'Harbour boat' WHEN t.route IN ('COAST') THEN t.route ELSE p.p_type END AS RouteType
FROM t LEFT JOIN part p ON CAST(p.p_partkey AS DOUBLE) = TRY_CAST(t.route AS DOUBLE)""")
def q_route_type_lookup(spark, sf_dir):
    """Route number from text, class by numeric lookup, named lines override."""
    li = driver_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.expr(_RT_TEXT.replace("VARCHAR", "STRING")).alias("ROUTE_SURVEYED"))
    classes = driver_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Route"),
                                                         F.col("p_type").alias("RouteType"))
    return attach_route_type(li, classes, named=["COAST"], renamed={"12": "Harbour boat"}) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "route", "RouteType")


@register("trip_ends", f"""{O.views('trip')}
SELECT {', '.join(k if k != 'l_extendedprice' else rsql(k) for k in O.TRIP_KEY)}, route,
       'Orig' AS Type, {rsql('o_lon', 'lon')}, {rsql('o_lat', 'lat')} FROM trip
UNION ALL
SELECT {', '.join(k if k != 'l_extendedprice' else rsql(k) for k in O.TRIP_KEY)}, route,
       'Dest' AS Type, {rsql('d_lon', 'lon')}, {rsql('d_lat', 'lat')} FROM trip""")
def q_trip_ends(spark, sf_dir):
    """Every trip unpivoted into an origin row and a destination row in one pass."""
    return trip_ends(trips(spark, sf_dir), keep=[*O.TRIP_KEY, "route"])


_KEY6 = [*O.TRIP_KEY[:4], "l_shipdate", "l_extendedprice"]
_K5 = ", ".join(k if k != "l_extendedprice" else rsql(k) for k in O.TRIP_KEY)


@register("trip_ends_keyed", f"""{O.views('trip')},
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {', '.join(_KEY6)}) AS rk FROM trip)
SELECT {_K5}, route, 'Orig' AS Type, rk * 2 - 1 AS Key, {rsql('o_lon', 'lon')}, {rsql('o_lat', 'lat')} FROM r
UNION ALL
SELECT {_K5}, route, 'Dest' AS Type, rk * 2 AS Key, {rsql('d_lon', 'lon')}, {rsql('d_lat', 'lat')} FROM r""")
def q_trip_ends_keyed(spark, sf_dir):
    """Trip ends with interleaved leg keys 1,3,5 / 2,4,6 in trip-key order."""
    t = trips(spark, sf_dir).select(*_KEY6, "route", "o_lon", "o_lat", "d_lon", "d_lat")
    return trip_ends(t, keep=[*O.TRIP_KEY, "route"], key_order=_KEY6)
