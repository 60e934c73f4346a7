"""Lines and point sets of trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators.quantile import global_rank, rank_within


def trip_lines(trips: DataFrame, key: Sequence[str], which: str = "od",
               coords: dict[str, tuple[str, str, str, str]] | None = None,
               explode: bool = False) -> DataFrame:
    """Two-point line per trip: origin-destination or boarding-alighting (G1).

    ``coords`` maps ``which`` to (lon1, lat1, lon2, lat2); rows missing a coordinate are
    skipped (F4).  ``explode=True`` gives one row per vertex ``(key..., vertex, lon, lat)``.
    """
    coords = coords or {"od": ("o_lon", "o_lat", "d_lon", "d_lat"),
                        "ba": ("b_lon", "b_lat", "a_lon", "a_lat")}
    lo1, la1, lo2, la2 = coords[which]
    t = trips.where(F.col(lo1).isNotNull() & F.col(la1).isNotNull()
                    & F.col(lo2).isNotNull() & F.col(la2).isNotNull())
    line = F.array(F.struct(F.lit(0).alias("vertex"), F.col(lo1).alias("lon"),
                            F.col(la1).alias("lat")),
                   F.struct(F.lit(1).alias("vertex"), F.col(lo2).alias("lon"),
                            F.col(la2).alias("lat")))
    out = t.select(*key, line.alias("vertices"))
    if explode:
        out = out.select(*key, F.inline("vertices"))
    return out


def points_to_line(points: DataFrame, lon: str, lat: str, id_field: str,
                   sort_field: str) -> DataFrame:
    """General polyline per id from its points ordered by a sort field (G1, O3).

    The points of one id are gathered into one array (bounded by that id's own points).
    """
    return points.groupBy(id_field).agg(F.array_sort(F.collect_list(F.struct(
        F.col(sort_field).alias("s"), F.col(lon).alias("lon"), F.col(lat).alias("lat")
    ))).alias("_p")).select(id_field, F.transform(
        "_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("vertices"))


def line_vertices(points: DataFrame, lon: str, lat: str, id_field: str, sort_field: str) -> DataFrame:
    """Polylines as rows ``(id, vertex, lon, lat)``: vertices numbered in the order of the sort field (G1, O3).

    Unlike :func:`points_to_line`, no array holds an id's points: an id of any length is spread
    over partitions and numbered by their offsets.  Equal sort values are ordered by the point.
    """
    rows = points.select(id_field, F.col(sort_field).alias("_sort"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    return rank_within(rows, [id_field], ["_sort"], "vertex").select(id_field, "vertex", "lon", "lat")


def trip_ends(trips: DataFrame, keep: Sequence[str],
              legs: dict[str, Sequence[tuple[str, str]]] | None = None,
              type_col: str = "Type", key_order: Sequence[str] | None = None,
              key_col: str = "Key") -> DataFrame:
    """Unpivot each trip into an ``Orig`` and a ``Dest`` row.

    ``legs`` maps the leg name to ``[(out, source), ...]`` column pairs, e.g. ``lon`` from
    ``o_lon`` for Orig and from ``d_lon`` for Dest.  One pass with ``explode`` (no union of
    two scans).  With ``key_order``, ``Key`` numbers the legs 1, 3, 5, ... (first leg) and
    2, 4, 6, ... (second leg) by the trips' position in that order (W2), from a
    distributed global rank.
    """
    legs = legs or {"Orig": [("lon", "o_lon"), ("lat", "o_lat")],
                    "Dest": [("lon", "d_lon"), ("lat", "d_lat")]}
    if key_order is not None:
        trips = global_rank(trips, list(key_order), out="_rank")
    structs = [F.struct(F.lit(name).alias(type_col),
                        *([(F.col("_rank") * len(legs) - (len(legs) - 1 - i)).alias(key_col)]
                          if key_order is not None else []),
                        *[F.col(src).alias(out) for out, src in pairs])
               for i, (name, pairs) in enumerate(legs.items())]
    return trips.select(*keep, F.explode(F.array(*structs)).alias("_l")).select(*keep, "_l.*")


def route_map(trips: DataFrame, key: Sequence[str], which: str = "od",
              coords: dict[str, tuple[str, str, str, str]] | None = None,
              attrs: Sequence[str] = (), label: "Column | None" = None
              ) -> tuple[DataFrame, DataFrame]:
    """Route map rows (Q2): the trips' lines and their end points.

    Returns ``(lines, ends)``: two-point lines as in :func:`trip_lines` (exploded), and one
    row per trip at the far end of the line with ``attrs`` and an optional ``label``.
    """
    coords = coords or {"od": ("o_lon", "o_lat", "d_lon", "d_lat"),
                        "ba": ("b_lon", "b_lat", "a_lon", "a_lat")}
    lines = trip_lines(trips, key, which, coords, explode=True)
    _, _, lo2, la2 = coords[which]
    cols = [*key, *attrs, F.col(lo2).alias("lon"), F.col(la2).alias("lat")]
    if label is not None:
        cols.append(label.alias("label"))
    ends = trips.where(F.col(lo2).isNotNull() & F.col(la2).isNotNull()).select(*cols)
    return lines, ends
