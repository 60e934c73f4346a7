"""SQL building blocks for the DuckDB oracle of each registered query.

The oracle is written independently of the DataFrame code: brute-force SQL over the same
stand-in views (a point is tested against every polygon edge, bands are matched with
BETWEEN, and so on).  Only the stand-in view text is shared.
"""

from __future__ import annotations

from odflow.sources.views import oracle_view

TRIP_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def views(*names: str) -> str:
    """``WITH`` clause defining the named stand-in views."""
    return "WITH " + ",\n".join(f"{n} AS (\n{oracle_view(n)}\n)" for n in names)


def inside_sql(px: str, py: str, e: str = "e") -> tuple[str, str]:
    """Per-edge crossing term and on-edge test for point (px, py) against edge alias ``e``."""
    cross = (f"CASE WHEN ({e}.y1 > {py}) <> ({e}.y2 > {py}) THEN "
             f"CASE WHEN {px} < ({e}.x2 - {e}.x1) * ({py} - {e}.y1) / ({e}.y2 - {e}.y1) + {e}.x1 "
             f"THEN 1 ELSE 0 END ELSE 0 END")
    on_edge = (f"(({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({e}.y2 - {e}.y1) * ({px} - {e}.x1) = 0 "
               f"AND {px} BETWEEN LEAST({e}.x1, {e}.x2) AND GREATEST({e}.x1, {e}.x2) "
               f"AND {py} BETWEEN LEAST({e}.y1, {e}.y2) AND GREATEST({e}.y1, {e}.y2))")
    return cross, on_edge


def point_zone_cte(name: str, source: str, lon: str, lat: str, edges: str = "zone_edge",
                   how: str = "first") -> str:
    """CTE ``name(lon, lat, zone)``: distinct points of ``source`` with their containing zone.

    ``how="first"``: the lowest containing zone id per point; ``"all"``: every containing zone.
    """
    cross, on_edge = inside_sql("p.lon", "p.lat")
    hits = (f"SELECT p.lon, p.lat, e.zone FROM (SELECT DISTINCT {lon} AS lon, {lat} AS lat "
            f"FROM {source} WHERE {lon} IS NOT NULL AND {lat} IS NOT NULL) p "
            f"CROSS JOIN {edges} e GROUP BY p.lon, p.lat, e.zone "
            f"HAVING BOOL_OR({on_edge}) OR SUM({cross}) % 2 = 1")
    if how == "all":
        return f"{name} AS ({hits})"
    return f"{name} AS (SELECT lon, lat, MIN(zone) AS zone FROM ({hits}) h GROUP BY lon, lat)"


def zone_trips_ctes(cols: list[str]) -> str:
    """CTEs up to ``zone_trips``: trip columns ``cols`` plus located zones and zone points."""
    sel = ", ".join(f"t.{c}" for c in cols)
    return ",\n".join([
        "zc AS (SELECT zone, MIN(cx) AS cx, MIN(cy) AS cy FROM zone_edge GROUP BY zone)",
        point_zone_cte("o_in", "trip", "o_lon", "o_lat"),
        point_zone_cte("d_in", "trip", "d_lon", "d_lat"),
        f"""zone_trips AS (SELECT {sel}, o.zone AS orig, zo.cx AS orig_lon, zo.cy AS orig_lat,
            d.zone AS dest, zd.cx AS dest_lon, zd.cy AS dest_lat
          FROM trip t
          LEFT JOIN o_in o ON o.lon = t.o_lon AND o.lat = t.o_lat
          LEFT JOIN zc zo ON zo.zone = o.zone
          LEFT JOIN d_in d ON d.lon = t.d_lon AND d.lat = t.d_lat
          LEFT JOIN zc zd ON zd.zone = d.zone)""",
    ])


def in_list(values) -> str:
    return "(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + ")"
