"""Registered queries over prepared, merged and clustered tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from odflow.operators._broadcast import materialize
from odflow.operators.box_state import box_state, flows_from_state, heat_from_state
from odflow.operators.density import cluster_pyramid
from odflow.operators.filters import options_all
from odflow.operators.joins import attach_weights
from odflow.operators.lines import line_vertices, trip_ends
from odflow.operators.panel import panel_flows, read_panel_summary, write_panel_summary
from odflow.operators.segments import correct_direction, orient_points, trip_direction
from odflow.plans import oracle as O
from odflow.plans import q_segments, q_spatial, q_survey
from odflow.plans.batch import preparation, run_stages
from odflow.plans.catalog import ORACLE, layer, register, rsql, trips
from odflow.plans.q_other import PF
from odflow.session import shared_dir
from odflow.sources import views as V
from odflow.sources.clustered import read_box, write_bucketed, write_clustered

KEY, KEY_SQL = q_spatial.KEY, q_spatial.KEY_SQL


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/odflow-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ boxes as a state
def _box(spark, b):
    return q_spatial._boxes(spark).where(F.col("zone_id") == b)


def _stacked(spark, sf_dir, direction, linked):
    """States of the boxes, made one by one as they are drawn."""
    state = None
    for b in q_spatial.BOXES:
        one = box_state(trips(spark, sf_dir), _box(spark, b), layer(spark, sf_dir), direction, linked, q_spatial.BOX_FILTERS)
        state = one if state is None else state.unionByName(one)
    return state


@register("box_heat_merged", ORACLE["box_heat"])
def q_box_heat_merged(spark, sf_dir):
    """Heat over three boxes whose states were made one by one and merged."""
    return heat_from_state(_stacked(spark, sf_dir, "orig", False), min_n=20.005).select("dest", "dest_lon", "dest_lat", "N", "colN")


@register("box_flows_merged", ORACLE["box_flows"])
def q_box_flows_merged(spark, sf_dir):
    """Flows per box from merged states."""
    return flows_from_state(_stacked(spark, sf_dir, "both", True)).select(
        "box_id", "orig_lon", "orig_lat", "dest", "dest_lon", "dest_lat", "N", "colN")


# ------------------------------------------------------------------ cascading lists
CASCADE = [("route", [1, 2, 3, 5, 8, 13]), ("route_type", None), ("time_period", ["1-URGENT", "2-HIGH"]),
           ("segment", ["MACHINERY", "BUILDING"]), ("flag", ["R", "A"]), ("o_zone", None)]


def _cascade_sql() -> str:
    parts, conds = [], ["TRUE"]
    for k, (var, chosen) in enumerate(CASCADE):
        domain = q_survey.DOMAINS.get(var)
        place = "NULL" if domain is None else "CASE " + " ".join(f"WHEN {var} = '{v}' THEN {i}" for i, v in enumerate(domain, 1)) + " END"
        also = f" AND {var} IN {O.in_list(domain)}" if domain else ""
        parts.append(f"SELECT {k} AS step, '{var}' AS variable, CAST({var} AS VARCHAR) AS value, CAST({place} AS INTEGER) AS ord, COUNT(*) AS n "
                     f"FROM trip WHERE {' AND '.join(conds)} AND {var} IS NOT NULL{also} GROUP BY {var}")
        if chosen is not None:
            conds.append(f"{var} IN {O.in_list(chosen)}")
    return f"{O.views('trip')}\n" + "\nUNION ALL ".join(parts)


@register("options_all", _cascade_sql())
def q_options_all(spark, sf_dir):
    """All lists of a six-step cascade from one scan."""
    return options_all(trips(spark, sf_dir), CASCADE, {v: q_survey.DOMAINS[v] for v, _ in CASCADE if v in q_survey.DOMAINS}) \
        .select("step", "variable", "value", "ord", "n")


# ------------------------------------------------------------------ clusters by zoom
_ZOOMS = (9, 14)


@register("cluster_pyramid", f"""{O.views('trip')},
p AS (SELECT o_lon AS lon, o_lat AS lat FROM trip WHERE o_lon IS NOT NULL AND o_lat IS NOT NULL AND route IN (1, 2, 3, 5, 8))
""" + "\nUNION ALL ".join(f"""SELECT {z} AS zoom, gx, gy, {'CAST(NULL AS BIGINT)' if z == _ZOOMS[0] else 'gx // 2'} AS parent_gx,
  {'CAST(NULL AS BIGINT)' if z == _ZOOMS[0] else 'gy // 2'} AS parent_gy, COUNT(*) AS n, {rsql('AVG(lon)', 'lon')}, {rsql('AVG(lat)', 'lat')}
FROM (SELECT *, CAST(FLOOR((lon + 180.0) / CAST({360 / 2 ** z!r} AS DOUBLE)) AS BIGINT) AS gx,
  CAST(FLOOR((lat + 180.0) / CAST({360 / 2 ** z!r} AS DOUBLE)) AS BIGINT) AS gy FROM p) c GROUP BY gx, gy""" for z in range(_ZOOMS[0], _ZOOMS[1] + 1)))
def q_cluster_pyramid(spark, sf_dir):
    """Clusters of trip origins at six zooms, each rolled up from one pass, with their parents."""
    return cluster_pyramid(trips(spark, sf_dir), "o_lon", "o_lat", _ZOOMS, routes=[1, 2, 3, 5, 8])


# ------------------------------------------------------------------ panel by month
_DECADE = "CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 10) AS INT)"


def _panel_of(spark, sf_dir):
    """The stand-in panel with a period in the place of the month (the events span one month)."""
    sql = V.VIEW_SQL["panel_od"].replace("AS idx\nFROM", f"AS idx, {_DECADE} AS month\nFROM").replace(
        "'weekend' END, value\nFROM", f"'weekend' END, value, {_DECADE}\nFROM")
    return spark.sql(sql, events=V.driver_table(spark, sf_dir, "events"))


@register("panel_by_month", ORACLE["panel_flows"])
def q_panel_by_month(spark, sf_dir):
    """Panel flows from summaries by period, one period delivered twice: its partition is replaced (A5, Q6)."""
    path, panel = _folder(spark), _panel_of(spark, sf_dir)
    write_panel_summary(panel.where("month <> 1").unionByName(panel.where("month = 1").withColumn("idx", F.col("idx") * 2)), path)
    write_panel_summary(panel.where("month = 1"), path)
    return panel_flows(read_panel_summary(spark, path), layer(spark, sf_dir), PF["parts"], PF["day_type"],
                       direction=PF["direction"], selection=PF["selection"])


# ------------------------------------------------------------------ clustered and bucketed tables
_CLUSTER_BOX = (-93.31, -93.12, 44.83, 44.97)


@register("clustered_box", f"""{O.views('trip')}
SELECT {KEY_SQL}, {rsql('t.o_lon', 'o_lon')}, {rsql('t.o_lat', 'o_lat')} FROM trip t
WHERE o_lon BETWEEN {_CLUSTER_BOX[0]} AND {_CLUSTER_BOX[1]} AND o_lat BETWEEN {_CLUSTER_BOX[2]} AND {_CLUSTER_BOX[3]}""")
def q_clustered_box(spark, sf_dir):
    """Trip origins written along a space-filling curve in tiles, and a box read from its tiles only."""
    path = _folder(spark)
    write_clustered(trips(spark, sf_dir).select(*KEY, "o_lon", "o_lat"), path, "o_lon", "o_lat", tile=0.1)
    return read_box(spark, path, "o_lon", "o_lat", _CLUSTER_BOX, tile=0.1).select(*KEY, "o_lon", "o_lat")


@register("bucketed_weights", f"""SELECT l_orderkey AS ID, l_linenumber, {rsql('o_totalprice', 'weight')}
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 7 <> 0""")
def q_bucketed_weights(spark, sf_dir):
    """Weights looked up between two tables bucketed by the record id, without an exchange."""
    name = f"odflow_{uuid.uuid4().hex}"
    t = V.driver_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ID"), "l_linenumber")
    w = V.driver_table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("weight"))
    return attach_weights(write_bucketed(t, f"{name}_t", ["ID"], 16), write_bucketed(w, f"{name}_w", ["ID"], 16), "ID")


# ------------------------------------------------------------------ lines of any length
@register("line_vertices", f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY EXTRACT(HOUR FROM ts), value, event_id) - 1 AS vertex,
  {rsql('value', 'lon')}, CAST(event_id AS DOUBLE) AS lat FROM events""")
def q_line_vertices(spark, sf_dir):
    """Points of each id as vertex rows, numbered by hour, without gathering an id (G1, O3)."""
    e = V.driver_table(spark, sf_dir, "events").select(
        "user_id", F.hour("ts").alias("hour"), F.col("value").alias("lon"), F.col("event_id").cast("double").alias("lat"))
    return line_vertices(e, "lon", "lat", "user_id", "hour")


# ------------------------------------------------------------------ directions, second pass
_FLIP_LINES, _FLIP_IDS = [1, 4], list(range(0, 4000, 37))


@register("trip_direction_corrected", f"""SELECT event_id, inferred_dir, {', '.join(rsql(f'CASE WHEN inferred_dir = 0 THEN {a} WHEN inferred_dir IS NOT NULL THEN {b} END', n) for n, a, b in
  (('orig_new_lon', 'ox', 'dx'), ('orig_new_lat', 'oy', 'dy'), ('dest_new_lon', 'dx', 'ox'), ('dest_new_lat', 'dy', 'oy')))}
FROM (SELECT event_id, CASE WHEN inferred_dir IN (0, 1) AND (CASE WHEN line_id IN {O.in_list(_FLIP_LINES)} AND board_seq > alight_seq THEN 1 ELSE 0 END
    + CASE WHEN event_id IN {O.in_list(_FLIP_IDS)} THEN 1 ELSE 0 END) = 1 THEN 1 - inferred_dir ELSE inferred_dir END AS inferred_dir,
  CAST(board_site AS DOUBLE) AS ox, CAST(board_site % 7 AS DOUBLE) AS oy, CAST(alight_site AS DOUBLE) AS dx, CAST(alight_site % 7 AS DOUBLE) AS dy
  FROM ({ORACLE['trip_direction']}) d) t""")
def q_trip_direction_corrected(spark, sf_dir):
    """Inferred directions corrected by line and by record, points turned to them."""
    r = correct_direction(trip_direction(V.ride(spark, sf_dir), V.stop_seq(spark, sf_dir)), _FLIP_LINES, _FLIP_IDS, id_col="event_id")
    at = {"o_lon": F.col("board_site").cast("double"), "o_lat": (F.col("board_site") % 7).cast("double"),
          "d_lon": F.col("alight_site").cast("double"), "d_lat": (F.col("alight_site") % 7).cast("double")}
    return orient_points(r.withColumns(at)).select("event_id", "inferred_dir", "orig_new_lon", "orig_new_lat", "dest_new_lon", "dest_new_lat")


# ------------------------------------------------------------------ legs and the whole batch
def _with_stops(t):
    """Boarding and alighting points of the stand-in trips: a tenth of the way from either end."""
    mix = lambda a, b: F.col(a) * 0.9 + F.col(b) * 0.1
    return t.withColumns({"b_lon": mix("o_lon", "d_lon"), "b_lat": mix("o_lat", "d_lat"),
                          "a_lon": mix("d_lon", "o_lon"), "a_lat": mix("d_lat", "o_lat")})


_STOPS_SQL = ("SELECT *, o_lon * 0.9 + d_lon * 0.1 AS b_lon, o_lat * 0.9 + d_lat * 0.1 AS b_lat, "
              "d_lon * 0.9 + o_lon * 0.1 AS a_lon, d_lat * 0.9 + o_lat * 0.1 AS a_lat FROM trip")


@register("trip_ends_alongside", f"""{O.views('trip')}, t AS ({_STOPS_SQL})
SELECT {KEY_SQL}, 'Orig' AS Type, {rsql('o_lon', 'lon')}, {rsql('o_lat', 'lat')}, {rsql('b_lon', 'ba_lon')}, {rsql('b_lat', 'ba_lat')} FROM t
UNION ALL SELECT {KEY_SQL}, 'Dest', {rsql('d_lon', 'lon')}, {rsql('d_lat', 'lat')}, {rsql('a_lon', 'ba_lon')}, {rsql('a_lat', 'ba_lat')} FROM t""")
def q_trip_ends_alongside(spark, sf_dir):
    """Both ends of every trip, each with its boarding or alighting point alongside."""
    legs = {"Orig": [("lon", "o_lon"), ("lat", "o_lat"), ("ba_lon", "b_lon"), ("ba_lat", "b_lat")],
            "Dest": [("lon", "d_lon"), ("lat", "d_lat"), ("ba_lon", "a_lon"), ("ba_lat", "a_lat")]}
    return trip_ends(_with_stops(trips(spark, sf_dir)), KEY, legs=legs)


_BATCH_KEEP = ["ID", "time_period", "w", "m"]


def _batch_sql() -> str:
    domain = O.in_list(q_survey.DOMAINS["time_period"])
    return f"""{O.views('trip', 'zone_edge', 'stop_seq', 'ride', 'panel_od')},
{q_segments.CLASSIFIED_SQL},
seg AS (SELECT site_id, line_id, segment FROM classified),
rides AS (SELECT b.segment AS bs, a.segment AS al FROM ride r
  JOIN seg b ON b.site_id = r.board_site AND b.line_id = r.line_id JOIN seg a ON a.site_id = r.alight_site AND a.line_id = r.line_id
  WHERE b.segment IS NOT NULL AND a.segment IS NOT NULL AND r.line_id IS NOT NULL AND time_period IS NOT NULL AND dir IS NOT NULL),
t0 AS ({_STOPS_SQL} WHERE l_orderkey % 10 <> 7),
t AS (SELECT * REPLACE (CASE WHEN time_period IN {domain} THEN time_period END AS time_period) FROM t0),
{O.point_zone_cte('o_in', 't', 'o_lon', 'o_lat')},
{O.point_zone_cte('d_in', 't', 'd_lon', 'd_lat')}
SELECT 'trip_ends' AS table_name, 'Orig' AS key, COUNT(*) AS n, ROUND(SUM(o_lon) - SUM(b_lat), 3) AS total FROM t
UNION ALL SELECT 'trip_ends', 'Dest', COUNT(*), ROUND(SUM(d_lon) - SUM(a_lat), 3) FROM t
UNION ALL SELECT 'od_lines', CAST(v AS VARCHAR), COUNT(*), ROUND(SUM(CASE v WHEN 0 THEN o_lon ELSE d_lon END), 3) FROM t, (VALUES (0), (1)) s(v)
  WHERE o_lon IS NOT NULL AND o_lat IS NOT NULL AND d_lon IS NOT NULL AND d_lat IS NOT NULL GROUP BY v
UNION ALL SELECT 'ba_lines', CAST(v AS VARCHAR), COUNT(*), ROUND(SUM(CASE v WHEN 0 THEN b_lon ELSE a_lon END), 3) FROM t, (VALUES (0), (1)) s(v)
  WHERE b_lon IS NOT NULL AND b_lat IS NOT NULL AND a_lon IS NOT NULL AND a_lat IS NOT NULL GROUP BY v
UNION ALL SELECT 'trips', time_period, COUNT(*), ROUND(SUM(w), 3) FROM t GROUP BY time_period
UNION ALL SELECT 'stop_segments', segment, COUNT(*), CAST(SUM(stop_sequence_number) AS DOUBLE) FROM classified GROUP BY segment
UNION ALL SELECT 'rides', bs || '>' || al, COUNT(*), CAST(NULL AS DOUBLE) FROM rides GROUP BY bs, al
UNION ALL SELECT 'panel', CAST(d_zone AS VARCHAR), COUNT(*), ROUND(SUM(idx) + SUM(z.cx), 3) FROM panel_od p
  LEFT JOIN (SELECT zone, MIN(cx) AS cx FROM zone_edge GROUP BY zone) z ON z.zone = p.o_zone GROUP BY d_zone
UNION ALL SELECT 'zone_trips', CAST(o.zone AS VARCHAR) || '>' || CAST(d.zone AS VARCHAR), COUNT(*), ROUND(SUM(w), 3) FROM t
  LEFT JOIN o_in o ON o.lon = t.o_lon AND o.lat = t.o_lat LEFT JOIN d_in d ON d.lon = t.d_lon AND d.lat = t.d_lat
  GROUP BY CAST(o.zone AS VARCHAR) || '>' || CAST(d.zone AS VARCHAR)"""


@register("preparation_batch", _batch_sql())
def q_preparation_batch(spark, sf_dir):
    """The whole batch written by committed stages, and every written table read back and summed (Q9)."""
    raw = _with_stops(trips(spark, sf_dir)).withColumn("ID", F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("."))).select(
        "ID", "time_period", "w", "m", *[f"{e}_{c}" for e in "odba" for c in ("lon", "lat")])
    stages = preparation(
        raw, "ID", layer(spark, sf_dir), V.stop_seq(spark, sf_dir), q_segments.RULES, [V.ride(spark, sf_dir)], V.panel_od(spark, sf_dir),
        survey={"codebook": {"time_period": q_survey.DOMAINS["time_period"]}, "exclude_pattern": "7."}, keep=_BATCH_KEEP, source=sf_dir)
    t = run_stages(spark, _folder(spark), stages)

    def of(name, key, total, n=F.count(F.lit(1))):
        return t[name].groupBy(key.alias("key")).agg(n.alias("n"), F.round(total, 3).alias("total")) \
            .select(F.lit(name).alias("table_name"), "key", "n", "total")

    c = F.col
    parts = [of("trip_ends", c("Type"), F.sum("lon") - F.sum("ba_lat")), of("od_lines", c("vertex").cast("string"), F.sum("lon")),
             of("ba_lines", c("vertex").cast("string"), F.sum("lon")), of("trips", c("time_period"), F.sum("w")),
             of("stop_segments", c("segment"), F.sum("stop_sequence_number").cast("double")),
             of("rides", F.concat("board_segment", F.lit(">"), "alight_segment"), F.max(F.lit(None).cast("double")), F.sum("copies")),
             of("panel", c("d_zone").cast("string"), F.sum("idx") + F.sum("orig_lon")),
             of("zone_trips", F.concat(c("orig").cast("string"), F.lit(">"), c("dest").cast("string")), F.sum("w"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
