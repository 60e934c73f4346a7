"""Weighted cross-tabs (A1) with shares (W1) and small-sample flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.weights import na_sum, na_sum_over, weight_col
from odflow.operators._broadcast import materialize, one_row
from odflow.operators.filters import filter_in


def _facets(x, y, facet) -> list[str]:
    out = []
    for v in (x, y, facet):
        if v is not None and v not in out:
            out.append(v)
    return out


def crosstab(trips: DataFrame, x: str | None = None, y: str | None = None,
             facet: str | None = None, filters: Mapping[str, Sequence | None] | None = None,
             linked: bool = False, domains: Mapping[str, Sequence[str]] | None = None,
             w: str = "w", m: str = "m") -> DataFrame:
    """Weighted cross-tab of 0 to 3 variables: ``obs`` rows and ``N`` effective weight.

    A plotted variable's own filter is replaced by its full domain (F2): with a codebook
    domain that drops NULL and out-of-domain values, without one every value (NULL included)
    forms a group.  ``N`` is NULL for a group holding a missing weight.  One hash aggregate
    with a map-side partial step; the output has one row per category combination.
    """
    facets = _facets(x, y, facet)
    flt = dict(filters or {})
    for v in facets:
        flt[v] = (domains or {}).get(v)
    df = filter_in(trips, flt)
    return df.groupBy(*facets).agg(F.count(F.lit(1)).alias("obs"),
                                   na_sum(weight_col(linked, w, m)).alias("N"))


def add_share(xtab: DataFrame, x: str | None = None, y: str | None = None,
              facet: str | None = None, col: str = "N", out: str = "share") -> DataFrame:
    """Share of ``N`` within x, within (x, facet), or overall.

    Partitioned windows run on the small cross-tab; for the overall total the cross-tab is
    written once, so that its rows and its one-row total share one pass over the trips.
    """
    if x is not None and y == x:
        y = None
    if facet is not None and facet in (x, y):
        facet = None
    if x is not None and y is not None:
        parts = [x] if facet is None else [x, facet]
        return xtab.withColumn(out, F.col(col) / na_sum_over(col, Window.partitionBy(*parts)))
    xtab = materialize(xtab)
    total = xtab.agg(na_sum(col).alias("_total"))
    return xtab.crossJoin(one_row(total)).withColumn(out, F.col(col) / F.col("_total")) \
        .drop("_total")


def sample_keys(x: str, y: str, facet: str | None) -> list[str]:
    """The columns whose groups the small-sample warning counts: x, and another facet."""
    return [x] if facet is None or facet in (x, y) else [x, facet]


def small_samples(xtab: DataFrame, x: str | None, y: str | None = None,
                  facet: str | None = None, n: int = 30) -> DataFrame:
    """Groups with fewer than ``n`` observations."""
    if x is None or y is None or x == y:
        return xtab.where(F.col("obs") < n)
    keys = sample_keys(x, y, facet)
    return xtab.groupBy(*keys).agg(F.sum("obs").alias("obs")).where(F.col("obs") < n)


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Frequency table of non-null values, ascending by count."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("n")
