"""Registered queries for selections' lines, layers with parts, and the smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from odflow.functions.text import percent_text, thousands
from odflow.operators._broadcast import materialize
from odflow.operators.clean import apply_overrides, cols_between, cols_like, direction_of, map_cols
from odflow.operators.codebook import apply_codebook, infer_domain, order_by_levels
from odflow.operators.crosstab import add_share, crosstab
from odflow.operators.density import by_role, point_density, point_listing
from odflow.operators.filters import filter_in
from odflow.operators.flows import flow_lines, od_flows
from odflow.operators.geometry_layer import layer_from_vertices, zone_centroids
from odflow.operators.joins import records_in
from odflow.operators.lines import points_to_line, route_map
from odflow.operators.locate import locate, located_in, zone_at
from odflow.operators.segments import at_nodes, at_seqs, attach_segments, band, classify_stops, on_off
from odflow.operators.selection import box_flows, individual_lines, individual_trips
from odflow.plans import oracle as O
from odflow.plans import q_flows, q_spatial
from odflow.plans.catalog import layer, register, rsql, trips
from odflow.plans.prepare import zone_trips
from odflow.session import shared_dir
from odflow.sources import views as V
from odflow.sources.io import export, load_prepared, read_stop_sequence, read_table, read_zones, write_prepared
from odflow.sources.views import driver_table

KEY, KEY_SQL = q_spatial.KEY, q_spatial.KEY_SQL
_K5 = ", ".join(k if k != "l_extendedprice" else rsql(k) for k in KEY)


# ------------------------------------------------------------- selections and boxes
def _lines_sql(base: str, id_col: str) -> str:
    """Two vertices of each selected trip; the near end is found again by its role."""
    cols = f"{', '.join(k for k in KEY)}, route, role, {id_col}, label"
    return f"""{base},
t2 AS (SELECT i.*, CASE WHEN i.role = 'orig' THEN t.o_lon ELSE t.d_lon END AS nx,
         CASE WHEN i.role = 'orig' THEN t.o_lat ELSE t.d_lat END AS ny
       FROM ind i JOIN trip t ON t.l_orderkey = i.l_orderkey AND t.l_linenumber = i.l_linenumber
        AND t.l_partkey = i.l_partkey AND t.l_suppkey = i.l_suppkey
        AND ROUND(t.l_extendedprice, 6) = ROUND(i.l_extendedprice, 6))
SELECT {cols}, 0 AS vertex, {rsql('nx', 'lon')}, {rsql('ny', 'lat')} FROM t2 WHERE lon IS NOT NULL AND lat IS NOT NULL
UNION ALL SELECT {cols}, 1, {rsql('lon')}, {rsql('lat')} FROM t2 WHERE lon IS NOT NULL AND lat IS NOT NULL"""


def _ind_cte(sql: str) -> str:
    """The individual-trips statement as a CTE ``ind`` after its own CTEs."""
    head, start, rest = sql.partition(f"\nSELECT {KEY_SQL}")
    return f"{head},\nind AS ({start}{rest})"


@register("individual_lines", _lines_sql(_ind_cte(q_spatial._ind_sql()), "sel_zone"))
def q_individual_lines(spark, sf_dir):
    """Lines of the trips with an end in the selected zones, near end to far end."""
    sel = layer(spark, sf_dir).where(F.col("zone_id").isin(q_spatial.SELECTION))
    ind = individual_trips(trips(spark, sf_dir), sel, direction="both", filters=q_spatial.IND_FILTERS,
                           keep=KEY, route="route", transfers_from=["flag"], transfers_to=["segment"])
    return individual_lines(ind).select(*KEY, "route", "role", "sel_zone", "label", "vertex", "lon", "lat")


def _box_ind_sql() -> str:
    rt = O.in_list(q_spatial.BOX_FILTERS["route"])
    label = "CAST(t.route AS VARCHAR) || ' ' || COALESCE(t.flag, '') || ' ' || COALESCE(t.segment, '')"
    return f"""{O.views('trip')},
{q_spatial._box_edges_sql()},
tf AS (SELECT * FROM trip WHERE route IN {rt}),
{O.point_zone_cte('near_o', 'tf', 'o_lon', 'o_lat', 'box_edge', how='all')}
SELECT {KEY_SQL}, t.route, 'orig' AS role, n.zone AS box_id, {rsql('t.d_lon', 'lon')}, {rsql('t.d_lat', 'lat')}, {label} AS label
FROM tf t JOIN near_o n ON n.lon = t.o_lon AND n.lat = t.o_lat"""


@register("box_individual", _box_ind_sql())
def q_box_individual(spark, sf_dir):
    """Trips starting in custom boxes, once for each of the boxes they start in (Q5)."""
    return individual_trips(trips(spark, sf_dir), q_spatial._boxes(spark), direction="orig",
                            filters=q_spatial.BOX_FILTERS, keep=KEY, route="route", transfers_from=["flag"],
                            transfers_to=["segment"], how="all", sel="box_id") \
        .select(*KEY, "route", "role", "box_id", "lon", "lat", "label")


_BF_SQL = q_spatial._box_sql("dest", False, False, 15.005)


@register("box_flow_lines", f"""WITH flows AS ({_BF_SQL})
SELECT box_id, dest, round_even(N, 0) AS counts, 'To ' || CAST(dest AS VARCHAR) || ': ' || CAST(CAST(round_even(N, 0) AS BIGINT) AS VARCHAR) AS label,
  {rsql('LOG2(round_even(N, 0)) + 1', 'line_weight')}, 0 AS vertex, {rsql('orig_lon', 'lon')}, {rsql('orig_lat', 'lat')} FROM flows
UNION ALL
SELECT box_id, dest, round_even(N, 0), 'To ' || CAST(dest AS VARCHAR) || ': ' || CAST(CAST(round_even(N, 0) AS BIGINT) AS VARCHAR),
  {rsql('LOG2(round_even(N, 0)) + 1', 'line_weight')}, 51, {rsql('dest_lon', 'lon')}, {rsql('dest_lat', 'lat')} FROM flows""")
def q_box_flow_lines(spark, sf_dir):
    """End vertices of the flow lines of custom boxes, labelled "To B: n" (G2, Q5, P16)."""
    flows = box_flows(trips(spark, sf_dir), q_spatial._boxes(spark), layer(spark, sf_dir), direction="dest",
                      linked=False, min_n=15.005, filters=q_spatial.BOX_FILTERS)
    return flow_lines(flows, n=50, explode=True, orig=None).where(F.col("vertex").isin(0, 51)) \
        .select("box_id", "dest", "counts", "label", "line_weight", "vertex", "lon", "lat")


_HALF = "CAST(l_quantity AS DOUBLE) / 2 AS N"


@register("flow_labels", f"""SELECT l_suppkey AS orig, l_linenumber AS dest, {_HALF}, round_even(l_quantity / 2, 0) AS counts,
  CAST(l_suppkey AS VARCHAR) || ' to ' || CAST(l_linenumber AS VARCHAR) || ': ' || CAST(CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS VARCHAR) AS label,
  CASE WHEN round_even(l_quantity / 2, 0) = 0 THEN CAST('-inf' AS DOUBLE) ELSE ROUND(LOG2(round_even(l_quantity / 2, 0)) + 1, 6) END AS line_weight
FROM lineitem""")
def q_flow_labels(spark, sf_dir):
    """Counts, labels and line weights of flows with half values, rounded to even."""
    flows = driver_table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS orig", "l_linenumber AS dest", _HALF, "CAST(0 AS DOUBLE) AS orig_lon", "CAST(0 AS DOUBLE) AS orig_lat",
        "CAST(1 AS DOUBLE) AS dest_lon", "CAST(1 AS DOUBLE) AS dest_lat")
    return flow_lines(flows, n=1).select("orig", "dest", "N", "counts", "label", "line_weight")


# -------------------------------------------------- layers with parts, holes, attributes
# Fixed parameters: one polygon with a hole, one of two parts, one concave ring; each ring
# is closed and the hole is drawn in the shell's direction.
SHAPES = {
    (1, 1, False): [(-93.5, 44.8), (-93.2, 44.8), (-93.2, 45.0), (-93.5, 45.0), (-93.5, 44.8)],
    (1, 2, True): [(-93.4, 44.85), (-93.3, 44.85), (-93.3, 44.95), (-93.4, 44.95), (-93.4, 44.85)],
    (2, 1, False): [(-93.15, 44.8), (-93.05, 44.8), (-93.05, 44.9), (-93.15, 44.9), (-93.15, 44.8)],
    (2, 2, False): [(-92.95, 45.0), (-92.85, 45.0), (-92.85, 45.1), (-92.95, 45.1), (-92.95, 45.0)],
    (3, 1, False): [(-93.5, 45.02), (-93.0, 45.02), (-93.0, 45.14), (-93.25, 45.05), (-93.5, 45.14), (-93.5, 45.02)],
}


def _shape_rows():
    return [(z, p, h, i, x, y, "county" if z == 1 else "city") for (z, p, h), ring in SHAPES.items()
            for i, (x, y) in enumerate(ring)]


def _shape_edges() -> str:
    rows = [f"({z}, '{'county' if z == 1 else 'city'}', {-1 if h else 1}, CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), "
            f"CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))" for (z, _, h), ring in SHAPES.items()
            for (x1, y1), (x2, y2) in zip(ring, ring[1:])]
    return f"shape AS (SELECT * FROM (VALUES {', '.join(rows)}) v(zone, kind, turn, x1, y1, x2, y2))"


def _shapes(spark):
    rows = spark.createDataFrame(_shape_rows(), "zone int, part int, hole boolean, seq int, x double, y double, kind string")
    path = f"{shared_dir(spark)}/odflow-shapes-{uuid.uuid4().hex}"
    write_prepared(rows, path)
    return read_zones(spark, path, zone="zone", part="part", hole="hole", attrs=["kind"])


@register("locate_parts", f"""{O.views('trip')},
{_shape_edges()},
{O.point_zone_cte('o_in', 'trip', 'o_lon', 'o_lat', 'shape')}
SELECT {KEY_SQL}, o.zone AS zone_id, (SELECT MIN(kind) FROM shape s WHERE s.zone = o.zone) AS kind
FROM trip t JOIN o_in o ON o.lon = t.o_lon AND o.lat = t.o_lat""")
def q_locate_parts(spark, sf_dir):
    """Trip origins in a layer with a hole, a two-part zone and a concave ring, with its attribute."""
    t = trips(spark, sf_dir).select(*KEY, "o_lon", "o_lat")
    return locate(t, _shapes(spark), "o_lon", "o_lat", carry={"kind": "kind"}).select(*KEY, "zone_id", "kind")


@register("layer_filter", f"""{O.views('trip')},
{_shape_edges()},
city AS (SELECT * FROM shape WHERE kind = 'city'),
{O.point_zone_cte('o_in', 'trip', 'o_lon', 'o_lat', 'city')}
SELECT o.zone AS zone_id, COUNT(*) AS n FROM trip t JOIN o_in o ON o.lon = t.o_lon AND o.lat = t.o_lat GROUP BY o.zone""")
def q_layer_filter(spark, sf_dir):
    """Trip origins per zone of the layer's city polygons."""
    city = _shapes(spark).where("kind = 'city'")
    return locate(trips(spark, sf_dir), city, "o_lon", "o_lat").groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


_MERC = "LN(TAN(PI() / 4 + {} * PI() / 360))"
_CR = f"turn * (x1 * {_MERC.format('y2')} - x2 * {_MERC.format('y1')})"


def _centroid_sql(source: str) -> str:
    return f"""SELECT zone AS zone_id, {rsql(f'SUM((x1 + x2) * {_CR}) / (3 * SUM({_CR}))', 'lon')},
  {rsql(f"(ATAN(EXP(SUM(({_MERC.format('y1')} + {_MERC.format('y2')}) * {_CR}) / (3 * SUM({_CR})))) * 2 - PI() / 2) * (180 / PI())", 'lat')}
FROM {source} GROUP BY zone"""


@register("ring_centroid", f"""{O.views('zone_edge')}, {_shape_edges()},
turned AS (SELECT zone, 1 AS turn, x1, y1, x2, y2 FROM zone_edge
  UNION ALL SELECT 100 + zone, turn, x1, y1, x2, y2 FROM shape)
{_centroid_sql('turned')}""")
def q_ring_centroid(spark, sf_dir):
    """Mercator centroids of the zone layer's rings and of polygons with parts and holes."""
    shapes = zone_centroids(_shapes(spark)).withColumn("zone_id", F.col("zone_id") + 100)
    return zone_centroids(layer(spark, sf_dir)).unionByName(shapes)


@register("clicked_zone", f"""{O.views('trip', 'zone_edge')},
click AS (SELECT CAST(-93.35 AS DOUBLE) AS x, CAST(44.94 AS DOUBLE) AS y),
{O.point_zone_cte('hit', 'click', 'x', 'y')},
{O.point_zone_cte('o_in', 'trip', 'o_lon', 'o_lat')}
SELECT {KEY_SQL}, o.zone AS zone_id FROM trip t JOIN o_in o ON o.lon = t.o_lon AND o.lat = t.o_lat JOIN hit ON hit.zone = o.zone""")
def q_clicked_zone(spark, sf_dir):
    """Trips that start in the zone under a clicked point."""
    lay = layer(spark, sf_dir)
    t = trips(spark, sf_dir).select(*KEY, "o_lon", "o_lat")
    clicked = materialize(zone_at(spark, -93.35, 44.94, lay))
    return located_in(t, lay, clicked, "o_lon", "o_lat").select(*KEY, "zone_id")


@register("od_flows_relation", f"""{O.views('trip', 'zone_edge')},
{O.zone_trips_ctes(O.TRIP_KEY + ['w', 'm'])},
sel AS (SELECT DISTINCT n_nationkey AS zone FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'),
g AS (SELECT orig, orig_lat, orig_lon, dest, dest_lat, dest_lon, CASE WHEN COUNT(w) = COUNT(*) THEN SUM(w) END AS N
  FROM zone_trips WHERE orig IN (SELECT zone FROM sel) AND dest NOT IN (SELECT zone FROM sel) GROUP BY ALL),
f AS (SELECT * FROM g WHERE N IS NOT NULL),
q AS (SELECT quantile_cont(N, 0.95) AS q FROM f)
SELECT orig, {rsql('orig_lat')}, {rsql('orig_lon')}, dest, {rsql('dest_lat')}, {rsql('dest_lon')}, {rsql('N')},
  {rsql('CASE WHEN N >= q THEN q ELSE N END', 'colN')} FROM f CROSS JOIN q""")
def q_od_flows_relation(spark, sf_dir):
    """Flows out of the zones that another query selects, destinations outside them (F7, Q3 with a table of zones)."""
    nation = V.driver_table(spark, sf_dir, "nation")
    region = V.driver_table(spark, sf_dir, "region").where(F.col("r_name").startswith("A"))
    sel = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("zone_id"))
    zt = zone_trips(trips(spark, sf_dir), layer(spark, sf_dir), keep=["w", "m"])
    return od_flows(zt, "orig", selection=sel, exclude_self=True)


# ---------------------------------------------------------------- cleaning and domains
@register("clean_columns", """SELECT o_orderkey, UPPER(o_orderstatus) AS o_orderstatus, UPPER(o_orderpriority) AS o_orderpriority,
  CASE WHEN regexp_extract(o_orderpriority || CASE o_custkey % 3 WHEN 0 THEN ' [NB]' WHEN 1 THEN ' [EB]' ELSE ' outbound' END, '\\[([NSEW]B)\\]', 1) <> ''
       THEN regexp_extract(o_orderpriority || CASE o_custkey % 3 WHEN 0 THEN ' [NB]' WHEN 1 THEN ' [EB]' ELSE ' outbound' END, '\\[([NSEW]B)\\]', 1)
       WHEN o_orderpriority = '5-LOW' THEN 'WB' END AS direction
FROM orders""")
def q_clean_columns(spark, sf_dir):
    """Columns picked by pattern and by range and mapped together; directions from text."""
    o = driver_table(spark, sf_dir, "orders")
    text = F.concat("o_orderpriority", F.expr("CASE o_custkey % 3 WHEN 0 THEN ' [NB]' WHEN 1 THEN ' [EB]' ELSE ' outbound' END"))
    o = o.withColumn("direction", direction_of(text, {"5-LOW outbound": "WB"}))
    picked = [c for c in cols_like(o, "o_order*") if c in cols_between(o, "o_orderstatus", "o_orderpriority") and c != "o_orderdate"]
    return map_cols(o, picked, F.upper).select("o_orderkey", *picked, "direction")


@register("overrides", """SELECT c.c_custkey, COALESCE(CASE WHEN s.s_suppkey IS NOT NULL AND s.s_acctbal > 0 THEN 'FIXED' END, c.c_mktsegment) AS c_mktsegment
FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def q_overrides(spark, sf_dir):
    """Manual corrections by record id; a missing correction leaves the value."""
    fix = driver_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.lit("FIXED")).alias("c_mktsegment"))
    return apply_overrides(driver_table(spark, sf_dir, "customer"), fix, "c_custkey", ["c_mktsegment"]) \
        .select("c_custkey", "c_mktsegment")


@register("inferred_domain", """SELECT p_type AS value, CAST(ROW_NUMBER() OVER (ORDER BY p_type) AS INT) AS ord
FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)""")
def q_inferred_domain(spark, sf_dir):
    """The sorted domain of a column, numbered."""
    return infer_domain(driver_table(spark, sf_dir, "part"), "p_type")


LEVELS = ["4-NOT SPECIFIED", "2-HIGH", "1-URGENT"]


@register("ordered_rows", f"""SELECT o_orderkey, o_orderpriority, ord AS o_orderpriority_ord,
  ROW_NUMBER() OVER (ORDER BY ord NULLS LAST, o_orderkey) - 1 AS position
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority IN {O.in_list(LEVELS)} THEN o_orderpriority END AS o_orderpriority,
        CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS ord FROM orders)""")
def q_ordered_rows(spark, sf_dir):
    """Rows in domain order, missing values last, with their position (O1, O2)."""
    from odflow.operators.quantile import global_rank
    o = apply_codebook(driver_table(spark, sf_dir, "orders"), {"o_orderpriority": LEVELS})
    o = order_by_levels(o, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_orderpriority_ord")
    rank = global_rank(o.withColumn("_last", F.col("o_orderpriority_ord").isNull()),
                       ["_last", "o_orderpriority_ord", "o_orderkey"], out="position")
    return rank.select("o_orderkey", "o_orderpriority", "o_orderpriority_ord", (F.col("position") - 1).alias("position"))


LONG = list(range(0, 6000, 3))


@register("long_list", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN {O.in_list(LONG)}")
def q_long_list(spark, sf_dir):
    """Rows whose key is in a list of two thousand values."""
    return filter_in(driver_table(spark, sf_dir, "lineitem"), {"l_orderkey": LONG}) \
        .select("l_orderkey", "l_linenumber", "l_partkey")


@register("percent_labels", """WITH x AS (SELECT l_returnflag, COUNT(*) AS obs, SUM(l_quantity) AS N FROM lineitem GROUP BY 1)
SELECT l_returnflag, format('{:,.0f}', N) AS total, format('{:,.1f}', N / (SELECT SUM(N) FROM x) * 100) || '%' AS share FROM x""")
def q_percent_labels(spark, sf_dir):
    """Totals with thousands separators and shares as percent text."""
    li = driver_table(spark, sf_dir, "lineitem").withColumns({"w": F.col("l_quantity"), "m": F.lit(1.0)})
    return add_share(crosstab(li, "l_returnflag"), "l_returnflag").select(
        "l_returnflag", thousands("N").alias("total"), percent_text("share").alias("share"))


# ------------------------------------------------------------------- lookups and stops
@register("stop_sequence", """SELECT p.p_partkey AS site_id, p.p_brand, o.line_id, o.seq FROM
(SELECT l_partkey AS site_id, l_suppkey % 6 AS line_id, l_linenumber AS seq FROM lineitem) o JOIN part p ON p.p_partkey = o.site_id""")
def q_stop_sequence(spark, sf_dir):
    """Stop sequence joined with its sites."""
    seq = driver_table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS site_id", "l_suppkey % 6 AS line_id", "l_linenumber AS seq")
    site = driver_table(spark, sf_dir, "part").selectExpr("p_partkey AS site_id", "p_brand")
    return read_stop_sequence(seq, site)[0].select("site_id", "p_brand", "line_id", "seq")


@register("route_stops", """SELECT DISTINCT l_partkey AS site_id, l_suppkey AS line_id, p_brand, s_nationkey
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def q_route_stops(spark, sf_dir):
    """Distinct star join of route stops, sites and lines."""
    site = driver_table(spark, sf_dir, "part").selectExpr("p_partkey AS site_id", "p_brand")
    stop = driver_table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS site_id", "l_suppkey AS line_id")
    line = driver_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line_id", "s_nationkey")
    return read_stop_sequence(stop, site, stop, line)[1].select("site_id", "line_id", "p_brand", "s_nationkey")


NODE_RULES = [at_seqs(1, 0, [3, 5, 8, 199], "quay"), at_nodes(2, ["N7", "N11"], "mill"), band(2, 1, 0, 120, "hill"),
              at_nodes(1, ["N3"], "gate")]


@register("classify_nodes", f"""{O.views('stop_seq')}
SELECT line_id, direction_number, stop_sequence_number, site_id, 'N' || CAST(site_id AS VARCHAR) AS node_id,
  CASE WHEN line_id = 1 AND site_id = 3 THEN 'gate'
       WHEN line_id = 2 AND direction_number = 1 AND stop_sequence_number BETWEEN 0 AND 120 THEN 'hill'
       WHEN line_id = 2 AND site_id IN (7, 11) THEN 'mill'
       WHEN line_id = 1 AND direction_number = 0 AND stop_sequence_number IN (3, 5, 8, 199) THEN 'quay' END AS segment
FROM stop_seq""")
def q_classify_nodes(spark, sf_dir):
    """Stops classified by node and by sequence-set rules, later rules first."""
    stops = V.stop_seq(spark, sf_dir).withColumn("node_id", F.concat(F.lit("N"), F.col("site_id").cast("string")))
    return classify_stops(stops, NODE_RULES, downtown_col=None).select(
        "line_id", "direction_number", "stop_sequence_number", "site_id", "node_id", "segment")


@register("on_off_union", f"""{O.views('ride', 'stop_seq')},
seg AS (SELECT site_id, line_id, CASE WHEN line_id = 1 AND direction_number = 0 AND stop_sequence_number IN (3, 5, 8, 199) THEN 'quay'
   WHEN line_id = 2 AND direction_number = 1 AND stop_sequence_number BETWEEN 0 AND 120 THEN 'hill' END AS segment FROM stop_seq),
a AS (SELECT r.event_id, r.line_id, r.time_period, r.dir, b.segment AS board_segment, x.segment AS alight_segment, 'ship' AS mode
  FROM ride r LEFT JOIN seg b ON b.site_id = r.board_site AND b.line_id = r.line_id
  LEFT JOIN seg x ON x.site_id = r.alight_site AND x.line_id = r.line_id WHERE r.line_id = 1),
c AS (SELECT r.event_id, r.line_id, r.time_period, r.dir, 'zone ' || CAST(r.board_site % 4 AS VARCHAR), 'zone ' || CAST(r.alight_site % 4 AS VARCHAR), NULL
  FROM ride r WHERE r.line_id = 4)
SELECT event_id, line_id, time_period, dir, board_segment, alight_segment, mode FROM a WHERE board_segment IS NOT NULL AND alight_segment IS NOT NULL
  AND time_period IS NOT NULL
UNION ALL SELECT * FROM c WHERE time_period IS NOT NULL""")
def q_on_off_union(spark, sf_dir):
    """Rides of two modes in one table by column name, complete cases only."""
    rides = V.ride(spark, sf_dir)
    stops = classify_stops(V.stop_seq(spark, sf_dir), [NODE_RULES[0], NODE_RULES[2]], downtown_col=None)
    ship = attach_segments(rides.where("line_id = 1"), stops).withColumn("mode", F.lit("ship"))
    zone = lambda c: F.concat(F.lit("zone "), (F.col(c) % 4).cast("string"))
    rail = rides.where("line_id = 4").withColumns({"board_segment": zone("board_site"), "alight_segment": zone("alight_site")})
    return on_off(ship, rail).select("event_id", "line_id", "time_period", "dir", "board_segment", "alight_segment", "mode")


# ------------------------------------------------------------------ lines and points
# The stand-in trips have no boarding points; a point between the ends stands for each.
_BA = {"b_lon": "o_lon * 0.75 + d_lon * 0.25", "b_lat": "o_lat * 0.75 + d_lat * 0.25",
       "a_lon": "o_lon * 0.25 + d_lon * 0.75", "a_lat": "o_lat * 0.25 + d_lat * 0.75"}
_BA_SQL = f"{O.views('trip')}, t AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _BA.items())} FROM trip WHERE route IN (2, 3))"


def _ba_trips(spark, sf_dir):
    return filter_in(trips(spark, sf_dir), {"route": [2, 3]}).withColumns({c: F.expr(e) for c, e in _BA.items()})


@register("boarding_lines", f"""{_BA_SQL}
SELECT {_K5}, 0 AS vertex, {rsql('b_lon', 'lon')}, {rsql('b_lat', 'lat')} FROM t WHERE b_lon IS NOT NULL
UNION ALL SELECT {_K5}, 1, {rsql('a_lon', 'lon')}, {rsql('a_lat', 'lat')} FROM t WHERE b_lon IS NOT NULL""")
def q_boarding_lines(spark, sf_dir):
    """Boarding-to-alighting lines of trips, two vertices each (G1, Q2)."""
    return route_map(_ba_trips(spark, sf_dir), KEY, which="ba")[0]


@register("point_roles", f"""{_BA_SQL}, p AS (
  SELECT 'origin' AS role, o_lon AS lon, o_lat AS lat FROM t UNION ALL SELECT 'destination', d_lon, d_lat FROM t
  UNION ALL SELECT 'boarding', b_lon, b_lat FROM t UNION ALL SELECT 'alighting', a_lon, a_lat FROM t)
SELECT role, CAST(FLOOR(lon / 0.02) AS BIGINT) AS gx, CAST(FLOOR(lat / 0.02) AS BIGINT) AS gy, COUNT(*) AS n FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2, 3""")
def q_point_roles(spark, sf_dir):
    """Densities of the origin, destination, boarding and alighting points, all in one pass."""
    roles = {"origin": ("o_lon", "o_lat"), "destination": ("d_lon", "d_lat"),
             "boarding": ("b_lon", "b_lat"), "alighting": ("a_lon", "a_lat")}
    return point_density(by_role(_ba_trips(spark, sf_dir), roles), "lon", "lat", cell=0.02, by=["role"])


@register("point_listing", f"""{O.views('trip')}
SELECT {_K5}, route, {rsql('o_lon', 'lon')}, {rsql('o_lat', 'lat')} FROM trip WHERE route IN (1, 4) AND o_lon IS NOT NULL AND o_lat IS NOT NULL""")
def q_point_listing(spark, sf_dir):
    """Trip origins of two routes, one row each, unclustered."""
    return point_listing(trips(spark, sf_dir), "o_lon", "o_lat", [*KEY, "route"], routes=[1, 4])


@register("ordered_lines", """SELECT l_orderkey, list(struct_pack(lon := CAST(l_partkey AS DOUBLE), lat := CAST(l_suppkey AS DOUBLE)) ORDER BY l_linenumber, l_partkey, l_suppkey)::VARCHAR AS line
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY l_orderkey""")
def q_ordered_lines(spark, sf_dir):
    """The polyline of each order's points by line number, as text (O3, G1)."""
    p = driver_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_partkey AS DOUBLE) AS lon", "CAST(l_suppkey AS DOUBLE) AS lat").distinct()
    line = points_to_line(p, "lon", "lat", "l_orderkey", "l_linenumber")
    text = F.transform("vertices", lambda v: F.concat(F.lit("{'lon': "), v["lon"].cast("string"), F.lit(", 'lat': "),
                                                      v["lat"].cast("string"), F.lit("}")))
    return line.select("l_orderkey", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("line"))


@register("matched_records", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)""")
def q_matched_records(spark, sf_dir):
    """Records whose id occurs in a result, each once."""
    result = driver_table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return records_in(driver_table(spark, sf_dir, "customer"), result, "c_custkey").select("c_custkey", "c_name")


# ---------------------------------------------------------------- sources and sinks
@register("export_roundtrip", """SELECT c_custkey, c_name AS name, c_mktsegment, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 12""")
def q_export_roundtrip(spark, sf_dir):
    """Customers written as prepared Parquet by nation, loaded, exported as CSV and read back."""
    path = f"{shared_dir(spark)}/odflow-export-{uuid.uuid4().hex}"
    write_prepared(driver_table(spark, sf_dir, "customer"), f"{path}/prepared/customers", partition_by=["c_nationkey"])
    ready = load_prepared(spark, f"{path}/prepared", ["customers"])["customers"].where("c_nationkey < 12")
    export(ready.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"), f"{path}/csv", "csv")
    return read_table(spark, f"{path}/csv", schema="c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int, c_acctbal double",
                      rename={"c_name": "name"})
