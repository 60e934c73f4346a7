"""Sources and sinks.

All readers declare or prune their columns so the scan reads only what is used; all writers
go through the DataFrame writer, so output is produced in parallel by the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from odflow.operators.geometry_layer import layer_from_vertices


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               rename: Mapping[str, str] | None = None, columns: Sequence[str] | None = None,
               fmt: str = "csv", **options) -> DataFrame:
    """Delimited (or any) file scan with a header; text stays text until cast with ``try_cast``.

    ``columns`` picks columns in the scan (pruned by the reader), ``rename`` renames them.
    A declared ``schema`` avoids the extra pass that inference would cost on large input.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    return df


def load_prepared(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Load prepared parquet tables ``root/<name>`` by name."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def write_prepared(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                   mode: str = "overwrite") -> None:
    """Persist a prepared table as parquet, optionally partitioned (e.g. by zone system)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Rows behind a download: parquet, csv (with header) or json lines."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def read_zones(spark: SparkSession, path: str, zone: str = "zone_id", seq: str = "seq",
               x: str = "x", y: str = "y", fmt: str = "parquet", **layer) -> DataFrame:
    """Polygon layer from an ordered vertex table ``(zone, seq, x, y, ...)``.

    Returns the canonical layer ``(zone_id, edges, minx, maxx, miny, maxy, cx, cy, ...)``.
    ``layer`` takes the further options of
    :func:`odflow.operators.geometry_layer.layer_from_vertices`: ``part``, ``hole``,
    ``attrs`` and the internal point ``cx``, ``cy``.
    """
    vertices = spark.read.format(fmt).load(path)
    return layer_from_vertices(vertices, zone=zone, seq=seq, x=x, y=y, **layer)


def read_stop_sequence(stop_sequence: DataFrame, site: DataFrame,
                       route_stop: DataFrame | None = None, line: DataFrame | None = None
                       ) -> tuple[DataFrame, DataFrame | None]:
    """Warehouse extracts as joins of exported tables.

    Returns the stop sequence joined with its site attributes (inner join on ``site_id``)
    and, when the route-stop and line tables are given, the DISTINCT star join of the three.
    """
    seq = stop_sequence.join(site, "site_id", "inner")
    star = None
    if route_stop is not None and line is not None:
        star = route_stop.join(site, "site_id", "inner").join(line, "line_id", "inner").distinct()
    return seq, star
