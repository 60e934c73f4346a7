"""Exact quantiles and global ranks without gathering a column, or its ties, in one task.

Values are first grouped with their counts, so ties of any size are one row.  The distinct
values are range-partitioned and written once; rows per partition (one small row each) give
every partition its offset, and ranks are counted inside partitions.  The same steps serve
every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.operators._broadcast import materialize


def _with_offsets(ranged: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """``ranged`` with ``_before``, the rows of its group in earlier partitions, and ``_all``."""
    parts = ranged.groupBy(*by, "_pid").agg(F.sum(n).alias("_rows"))
    # One row per partition and group that reaches into it.
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_pid")
    offsets = parts.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_pid").alias("_p"),
        F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*by, F.lit(0))).alias("_all"))
    on = F.col("_pid") == F.col("_p")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return ranged.join(offsets, on).drop("_p", *[f"_k_{c}" for c in by])


def exact_quantiles(df: DataFrame, col: str, p: float, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """``(by..., q)``: the p-quantile of ``col`` per group (R type 7, linear interpolation).

    NULLs are ignored; a group without values has no row (without ``by``: one row, NULL).
    """
    by = list(by)
    values = (df.select(*by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranged = materialize(values.repartitionByRange(*by, "_v").withColumn("_pid", F.spark_partition_id()))
    # Ranks count from 0; a value covers the ranks from _upto - _n to _upto - 1.
    ranked = _with_offsets(ranged, by, "_n").withColumn("_upto", F.col("_before") + F.sum("_n").over(
        Window.partitionBy(*by, "_pid").orderBy("_v")))
    pos = (F.col("_all") - 1) * F.lit(float(p))
    lo, hi = F.floor(pos), F.ceil(pos)
    found = ranked.groupBy(*by).agg(
        F.min(F.when(F.col("_upto") > lo, F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > hi, F.col("_v"))).alias("_hi"), F.max("_all").alias("_all"))
    q = F.when(lo == hi, F.col("_lo")).otherwise((hi - pos) * F.col("_lo") + (pos - lo) * F.col("_hi"))
    return found.select(*by, q.alias(out))


def exact_quantile(df: DataFrame, col: str, p: float) -> float | None:
    """The p-quantile of a whole column as a number."""
    return exact_quantiles(df, col, p).first()[0]


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """1-based position of every row in ``order`` (ties broken by the remaining columns).

    Rows are range-partitioned by all columns, so rows that share the order columns are
    spread as well; each partition is numbered by itself, after the rows before it.
    """
    columns = [*order, *[c for c in df.columns if c not in order]]
    ranged = materialize(df.repartitionByRange(*columns).withColumn("_pid", F.spark_partition_id()))
    counted = _with_offsets(ranged.withColumn("_one", F.lit(1)), [], "_one")
    w = Window.partitionBy("_pid").orderBy(*columns)
    return counted.withColumn(out, F.row_number().over(w) + F.col("_before")) \
        .drop("_pid", "_one", "_before", "_all")


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """0-based position of every row in ``order`` inside its group ``by`` (ties by the other columns).

    Rows are range-partitioned by group and order, so one group may take many partitions; rows
    are numbered where they lie, and each partition's number of rows of a group gives the
    offset of the next.  No group is gathered.
    """
    by = list(by)
    columns = [*by, *order, *[c for c in df.columns if c not in (*by, *order)]]
    at = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(at.withColumn("_pid", F.shiftright("_at", 33)))
    counted = _with_offsets(ranged.withColumn("_one", F.lit(1)), by, "_one")
    first = ranged.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_pid").alias("_p")).agg(F.min("_at").alias("_first"))
    on = F.col("_pid") == F.col("_p")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return counted.join(first, on).withColumn(out, F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, out)
