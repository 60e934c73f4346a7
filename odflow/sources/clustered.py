"""Clustered and bucketed tables (O4, S5): layouts that let later reads skip files and shuffles.

``write_clustered`` orders points along a space-filling curve: the bits of both coordinates
are interleaved, so rows near each other on the map are near each other in the files.  The
table is partitioned by square tiles, which prune whole directories when a box is read, and
range-partitioned and sorted by the curve inside them, which keeps the value ranges of row
groups narrow and splits a crowded tile over several files.  ``write_bucketed`` stores a table
hashed by its keys; two tables bucketed alike join on them without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_X, TILE_Y = "tile_x", "tile_y"
_BITS = 16


def _spread(c: str) -> str:
    """The low 16 bits of a number with a zero between neighbours."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = f"(({c} | shiftleft({c}, {shift})) & {mask}L)"
    return c


def curve_key(lon: str, lat: str, tile: float) -> Column:
    """Place of a point on the curve inside its tile: 16 bits of each coordinate, interleaved."""
    def part(c):
        scaled = f"{c} / {tile!r}D"
        return f"CAST(floor(({scaled} - floor({scaled})) * {1 << _BITS}) AS BIGINT)"
    return F.expr(f"_x | shiftleft(_y, 1)".replace("_x", _spread(part(lon))).replace("_y", _spread(part(lat))))


def write_clustered(df: DataFrame, path: str, lon: str, lat: str, tile: float = 0.05, files: int | None = None,
                    mode: str = "overwrite") -> None:
    """``df`` as Parquet in tiles of ``tile`` degrees, along the curve inside them.

    Rows without coordinates go to a tile of their own (null), spread by no key.
    """
    here = F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    index = lambda c: F.when(here, F.floor(F.col(c) / F.lit(tile)).cast("int"))
    keyed = df.withColumns({TILE_X: index(lon), TILE_Y: index(lat), "_key": F.when(here, curve_key(lon, lat, tile)),
                            "_tie": F.monotonically_increasing_id()})
    order = [TILE_X, TILE_Y, "_key", "_tie"]
    ranged = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_key", "_tie").write.mode(mode).partitionBy(TILE_X, TILE_Y).parquet(path)


def read_box(spark: SparkSession, path: str, lon: str, lat: str, box: tuple[float, float, float, float],
             tile: float = 0.05) -> DataFrame:
    """Rows of a clustered table inside ``(minx, maxx, miny, maxy)``; other tiles are not opened."""
    x0, x1, y0, y1 = box
    to = lambda v: F.floor(F.lit(float(v)) / F.lit(tile)).cast("int")
    rows = spark.read.parquet(path).where(F.col(TILE_X).between(to(x0), to(x1)) & F.col(TILE_Y).between(to(y0), to(y1)))
    return rows.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)).drop(TILE_X, TILE_Y)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "overwrite") -> DataFrame:
    """``df`` as a catalog table in ``buckets`` hash buckets by ``keys``, sorted by them; returns the table."""
    by = list(keys)
    (df.repartition(buckets, *by).sortWithinPartitions(*by)
     .write.mode(mode).format("parquet").bucketBy(buckets, by[0], *by[1:]).sortBy(by[0], *by[1:]).saveAsTable(table))
    return df.sparkSession.table(table)
