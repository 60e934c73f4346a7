"""Third-party O-D panel (Q6: F8, J7, P14, U2, A5, A9, J10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.operators.filters import filter_day_parts, select_zones
from odflow.operators.flows import FLOW_KEYS, intensity, orient, zone_layer
from odflow.operators.joins import attach_centroids


def _base(panel, parts, day_type, orig, dest, idx, all_day):
    f = filter_day_parts(panel, parts, day_type, all_day=all_day)
    return f.select(F.col(orig).alias("orig"), F.col(dest).alias("dest"),
                    F.col(idx).alias("idx"))


def panel_flows(panel: DataFrame, points: DataFrame, parts: Sequence[str], day_type: str,
                direction: str = "orig", selection: Sequence | None = None,
                exclude_self: bool = False, orig: str = "o_zone", dest: str = "d_zone",
                idx: str = "idx", all_day: str = "0") -> DataFrame:
    """Panel index flows between zone pairs from the selection (Q6 flows).

    Day parts are summed (missing values skipped, an all-missing pair gives 0); the value
    is not capped: ``colN = N``.  Zone points come from a broadcast lookup (J7).
    """
    f = attach_centroids(_base(panel, parts, day_type, orig, dest, idx, all_day), points)
    f = orient(f, direction)
    if selection is not None:
        f = select_zones(f, selection, exclude_self)
    g = f.groupBy(*FLOW_KEYS).agg(F.coalesce(F.sum("idx"), F.lit(0.0)).alias("N"))
    return g.withColumn("colN", F.col("N"))


def panel_heat(panel: DataFrame, layer: DataFrame, parts: Sequence[str], day_type: str,
               direction: str = "orig", selection: Sequence | None = None,
               exclude_self: bool = False, orig: str = "o_zone", dest: str = "d_zone",
               idx: str = "idx", all_day: str = "0") -> DataFrame:
    """Panel index summed per destination zone, joined to the layer, with intensity."""
    f = orient(_base(panel, parts, day_type, orig, dest, idx, all_day), direction,
               pairs=(("orig", "dest"),))
    if selection is not None:
        f = select_zones(f, selection, exclude_self)
    h = f.groupBy("dest").agg(F.coalesce(F.sum("idx"), F.lit(0.0)).alias("N"))
    return intensity(zone_layer(layer, h, key="dest"), "N")


def write_panel_summary(panel: DataFrame, path: str, month: str = "month", orig: str = "o_zone", dest: str = "d_zone",
                        idx: str = "idx") -> None:
    """Partial aggregates of a panel by month, in one partition a month (A5, Q6).

    Rows: zone pair, day type and day part with ``rows``, ``present`` and ``idx`` (the sum of the
    present values, missing where all are).  Months in ``panel`` replace their own partitions
    and no other, so a late or corrected month is written by itself.
    """
    g = panel.groupBy(month, orig, dest, "day_type", "day_part").agg(
        F.count(F.lit(1)).alias("rows"), F.count(idx).alias("present"), F.sum(idx).alias(idx))
    (g.repartition(month, F.pmod(F.xxhash64(orig), F.lit(8))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path))


def read_panel_summary(spark: SparkSession, path: str, months: Sequence | None = None, month: str = "month") -> DataFrame:
    """The summaries of all or the given months, as a panel for :func:`panel_flows` and :func:`panel_heat`.

    Sums of the months' sums are the panel's sums; a pair missing everywhere stays missing.
    """
    df = spark.read.parquet(path)
    return df if months is None else df.where(F.col(month).isin(list(months)))
