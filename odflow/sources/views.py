"""Stand-in inputs built from the driver tables.

The reference reads survey files that are not public.  These views only reshape the driver
tables into the input schemas the operators expect (trips with weights and coordinates, a
polygon layer, stop sequences, rides, an O-D panel); they do none of an operator's work.
The same SQL text runs on Spark (tables bound as DataFrame arguments of ``spark.sql``) and
on DuckDB for the oracle (``oracle_view``), so both engines see identical input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The stand-in view definitions (input schemas of FIXTURES.md part B).
VIEW_SQL: dict[str, str] = {
    "trip": """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice,
       CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE l.l_quantity END AS w,
       1 - l.l_discount AS m,
       CAST(l.l_suppkey % 20 AS INT) AS route,
       p.p_type AS route_type,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE o.o_orderpriority END AS time_period,
       c.c_mktsegment AS segment,
       l.l_returnflag AS flag,
       CASE WHEN l.l_returnflag = 'R' THEN 'Yes' ELSE '' END AS sel_a,
       CASE WHEN l.l_linestatus = 'O' THEN 'Yes' ELSE '' END AS sel_b,
       CASE WHEN p.p_size > 40 THEN 'Yes' ELSE '' END AS sel_c,
       CASE WHEN l.l_partkey % 53 = 0 THEN NULL ELSE
         CAST(-93.6 AS DOUBLE) + CAST((l.l_orderkey * 7919 + l.l_linenumber * 104729) % 10007 AS DOUBLE) / 10007 * CAST(0.8 AS DOUBLE) END AS o_lon,
       CAST(44.75 AS DOUBLE) + CAST((l.l_partkey * 6037 + l.l_suppkey * 271 + l.l_linenumber * 13) % 10009 AS DOUBLE) / 10009 * CAST(0.4 AS DOUBLE) AS o_lat,
       CAST(-93.6 AS DOUBLE) + CAST((l.l_partkey * 3571 + l.l_orderkey * 17) % 10007 AS DOUBLE) / 10007 * CAST(0.8 AS DOUBLE) AS d_lon,
       CAST(44.75 AS DOUBLE) + CAST((l.l_orderkey * 2459 + l.l_suppkey * 389) % 10009 AS DOUBLE) / 10009 * CAST(0.4 AS DOUBLE) AS d_lat,
       s.s_nationkey AS o_zone, c.c_nationkey AS d_zone
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {part} p ON l.l_partkey = p.p_partkey
""",
    "zone_edge": """
SELECT n_nationkey AS zone, e.i AS seq,
  cx + CASE e.i WHEN 0 THEN CAST(0.08 AS DOUBLE) WHEN 2 THEN CAST(-0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x1,
  cy + CASE e.i WHEN 1 THEN CAST(0.04 AS DOUBLE) WHEN 3 THEN CAST(-0.04 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y1,
  cx + CASE e.i WHEN 3 THEN CAST(0.08 AS DOUBLE) WHEN 1 THEN CAST(-0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x2,
  cy + CASE e.i WHEN 0 THEN CAST(0.04 AS DOUBLE) WHEN 2 THEN CAST(-0.04 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y2,
  cx, cy
FROM (SELECT n_nationkey, CAST(-93.52 AS DOUBLE) + CAST(0.16 AS DOUBLE) * (n_nationkey % 5) AS cx,
             CAST(44.79 AS DOUBLE) + CAST(0.08 AS DOUBLE) * FLOOR(CAST(n_nationkey AS DOUBLE) / 5) AS cy FROM {nation}) z
CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) e
""",
    "stop_seq": """
SELECT CAST(FLOOR(CAST(p_partkey AS DOUBLE) / 200) AS INT) % 6 AS line_id,
       CASE WHEN p_partkey >= 1200 THEN 1 ELSE 0 END AS direction_number,
       CAST(p_partkey % 200 AS INT) AS stop_sequence_number, CAST(p_partkey % 200 AS BIGINT) AS site_id,
       CASE WHEN p_brand = 'Brand#1' THEN 'Y' ELSE 'N' END AS site_downtown_zone
FROM {part}
""",
    "ride": """
SELECT event_id, CAST(user_id % 6 AS INT) AS line_id,
       CAST((event_id * 7) % 200 AS BIGINT) AS board_site, CAST((event_id * 13 + user_id) % 200 AS BIGINT) AS alight_site,
       CASE WHEN user_id % 2 = 0 THEN 'NB' ELSE 'SB' END AS dir, event_type AS time_period
FROM {events}
""",
    "panel_od": """
SELECT user_id % 25 AS o_zone, event_id % 25 AS d_zone,
       CASE WHEN EXTRACT(HOUR FROM ts) < 6 THEN '1' WHEN EXTRACT(HOUR FROM ts) < 12 THEN '2' ELSE '3' END AS day_part,
       CASE WHEN EXTRACT(DAY FROM ts) % 7 < 5 THEN 'weekday' ELSE 'weekend' END AS day_type,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS idx
FROM {events}
UNION ALL
SELECT user_id % 25, event_id % 25, '0', CASE WHEN EXTRACT(DAY FROM ts) % 7 < 5 THEN 'weekday' ELSE 'weekend' END, value
FROM {events}
""",
}

_VIEW_TABLES = {
    "trip": ("lineitem", "orders", "customer", "supplier", "part"),
    "zone_edge": ("nation",),
    "stop_seq": ("part",),
    "ride": ("events",),
    "panel_od": ("events",),
}


# Declared schemas of the driver tables the views read (as written in the
# parquet files), so that a scan needs no footer read for schema inference.
DRIVER_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table with its declared schema; the scan prunes columns and pushes filters."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in DRIVER_SCHEMAS:
        return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: driver_table(spark, sf_dir, t) for t in _VIEW_TABLES[name]}
    return spark.sql(VIEW_SQL[name], **tables)


def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "trip")


def zone_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "zone_edge")


def stop_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "stop_seq")


def ride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "ride")


def panel_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "panel_od")


def oracle_view(name: str) -> str:
    """The view SQL for DuckDB, where the driver tables are plain views of the same name."""
    return VIEW_SQL[name].format(**{t: t for t in _VIEW_TABLES[name]}).strip()
