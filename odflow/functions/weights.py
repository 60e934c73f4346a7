"""Survey weights and the missing-value-propagating sum."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weight_col(linked: bool, w: str = "w", m: str = "m") -> Column:
    """Effective weight: the trip-leg weight, or weight times the linked-trip multiplier."""
    return _col(w) * _col(m) if linked else _col(w)


def na_sum(c: str | Column) -> Column:
    """Aggregate sum that is NULL as soon as one input is NULL.

    Spark's ``sum`` skips nulls; a survey total over a group with a missing weight must
    stay missing so that the group is later dropped by thresholds and complete-case filters.
    Both counts are ordinary partial aggregates, so the map-side combine is kept.
    """
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def na_sum_over(c: str | Column, window: WindowSpec | None = None) -> Column:
    """Window form of :func:`na_sum`."""
    c = _col(c)
    w = window if window is not None else Window.partitionBy()
    return F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), F.sum(c).over(w))
