"""Lookup joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions.text import first_token, to_number


def attach_weights(trips: DataFrame, weights: DataFrame, key: str = "ID") -> DataFrame:
    """Left lookup of survey weights by record id.

    Weights are per record, as large as the trips, so this is a shuffle (sort-merge) join
    on the id; AQE splits skewed ids.  No broadcast: the side grows with the data.
    """
    return trips.join(weights, key, "left")


def attach_route_type(trips: DataFrame, classes: DataFrame, route_text: str = "ROUTE_SURVEYED",
                      class_key: str = "Route", class_value: str = "RouteType",
                      named: Sequence[str] = (), renamed: Mapping[str, str] | None = None,
                      route_out: str = "route", type_out: str = "RouteType") -> DataFrame:
    """Route number from the route text and its class by a numeric lookup.

    The route is the first token of the text; its tolerant numeric cast is the key of a
    left lookup into the class table.  Routes without a number get a key by a hash of
    their text, which no class has, so different ones do not meet under one NULL key.  Named lines listed in ``named``
    take their own name as class, ``renamed`` maps further routes to fixed classes; later
    rules win, as in the reference.
    """
    t = trips.withColumn(route_out, first_token(route_text)) \
        .withColumn("_rkey", F.struct(to_number(route_out).alias("n"), F.when(
            to_number(route_out).isNull(), F.xxhash64(route_text)).alias("h")))
    # Struct keys compare NULL fields as equal: a class never has a hash, a nameless route has no number.
    c = classes.where(F.col(class_key).isNotNull()).select(
        F.struct(F.col(class_key).cast("double").alias("n"), F.lit(None).cast("bigint").alias("h")).alias("_rkey"),
        F.col(class_value).alias(type_out))
    t = t.join(c, "_rkey", "left").drop("_rkey")
    rt = F.col(type_out)
    if named:
        rt = F.when(F.col(route_out).isin(list(named)), F.col(route_out)).otherwise(rt)
    for r, v in (renamed or {}).items():
        rt = F.when(F.col(route_out) == F.lit(r), F.lit(v)).otherwise(rt)
    return t.withColumn(type_out, rt)


def attach_centroids(df: DataFrame, points: DataFrame, orig: str = "orig", dest: str = "dest",
                     zone: str = "zone_id", lon: str = "cx", lat: str = "cy") -> DataFrame:
    """Zone point joined twice, as origin and as destination; unmatched rows kept.

    The zone table is layer-sized; the planner broadcasts it where its size allows.
    """
    p = points.select(zone, lon, lat)
    po = p.select(F.col(zone).alias("_oz"), F.col(lon).alias("orig_lon"),
                  F.col(lat).alias("orig_lat"))
    pd = p.select(F.col(zone).alias("_dz"), F.col(lon).alias("dest_lon"),
                  F.col(lat).alias("dest_lat"))
    out = df.join(po, df[orig] == po["_oz"], "left").drop("_oz")
    return out.join(pd, out[dest] == pd["_dz"], "left").drop("_dz")


def records_in(df: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Records whose id occurs in a result, without duplication (J11): a left semi join."""
    return df.join(result.select(key), key, "left_semi")
