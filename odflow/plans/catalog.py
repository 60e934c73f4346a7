"""Registry of named queries: the Spark plan and its DuckDB oracle SQL side by side.

Every query reads whole driver tables (through the stand-in views) and runs the library's
operators on them; parameters such as filter values, selections, boxes and rule lists are
the fixed inputs a user would pick.  Double columns are rounded to 6 digits on both sides
so that the comparison is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from odflow.operators.geometry_layer import layer_from_edges
from odflow.plans import oracle as O
from odflow.plans.prepare import zone_trips
from odflow.sources import views as V

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = [F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


# --------------------------------------------------------------------------- inputs
TRIP_COLS = O.TRIP_KEY + ["w", "m", "route", "route_type", "time_period"]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.trip(spark, sf_dir)


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25-zone polygon layer built from the edge view."""
    return layer_from_edges(V.zone_edge(spark, sf_dir))


def located_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_trips(trips(spark, sf_dir), layer(spark, sf_dir), keep=TRIP_COLS)


def rsql(expr: str, alias: str | None = None) -> str:
    return f"ROUND({expr}, {DIGITS}) AS {alias or expr}"
