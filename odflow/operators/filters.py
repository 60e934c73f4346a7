"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.operators.codebook import level_ord


def filter_in(df: DataFrame, filters: Mapping[str, Sequence | None] | None) -> DataFrame:
    """Conjunction of optional IN-lists; ``None`` means no filter, an empty list keeps nothing.

    A list of any length becomes an ``IN`` predicate (a hashed set beyond ten values), which
    reaches the parquet scan as a pushed filter (F3).
    """
    for col, vals in (filters or {}).items():
        if vals is None:
            continue
        df = df.where(F.col(col).isin(list(vals)))
    return df


def has_point(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows with both coordinates present (F4); a coordinate that is not a number is missing."""
    return df.where(present(lon) & present(lat))


def present(col: str | Column) -> Column:
    """Whether a coordinate is there: neither NULL nor NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c)


def complete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Complete cases over ``cols`` (all columns when omitted)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def min_n(df: DataFrame, n: float, col: str = "N") -> DataFrame:
    """Minimum group size after aggregation (F6); NULL totals are dropped as well."""
    return df.where(F.col(col) >= F.lit(n))


def select_zones(df: DataFrame, ids: Sequence, exclude_self: bool = False,
                 orig: str = "orig", dest: str = "dest") -> DataFrame:
    """Origin in the selection; optionally destination outside it.

    ``NOT (dest IN sel)`` is made null-safe: a missing destination is "not in" the selection
    (it is removed later by the complete-case step, as in the reference).
    """
    ids = list(ids)
    out = df.where(F.col(orig).isin(ids))
    if exclude_self:
        out = out.where(~F.coalesce(F.col(dest).isin(ids), F.lit(False)))
    return out


def select_zones_in(df: DataFrame, selected: DataFrame, exclude_self: bool = False, orig: str = "orig",
                    dest: str = "dest", zone: str = "zone_id") -> DataFrame:
    """Origin in a table of selected zones; optionally destination not in it (F7 as a relation).

    Two joins, ``left_semi`` and ``left_anti``, against the distinct zones: a selection of any
    length, and where the fact is partitioned by the origin the planner prunes its partitions
    by the selection at run time.  A missing destination is not in the selection.
    """
    ids = selected.select(F.col(zone).alias("_zone")).where("_zone IS NOT NULL").distinct()
    out = df.join(ids, F.col(orig) == F.col("_zone"), "left_semi")
    return out.join(ids, F.col(dest) == F.col("_zone"), "left_anti") if exclude_self else out


def filter_day_parts(df: DataFrame, parts: Sequence[str], day_type: str,
                     all_day: str = "0", part_col: str = "day_part",
                     type_col: str = "day_type") -> DataFrame:
    """Day-part filter (F8): when the all-day code is requested only all-day rows count."""
    parts = [all_day] if all_day in parts else list(parts)
    return df.where(F.col(part_col).isin(parts) & (F.col(type_col) == F.lit(day_type)))


def filter_eq(df: DataFrame, col: str, value, any_value: str = "All") -> DataFrame:
    """Equality filter with a wildcard value meaning "no filter" (F9)."""
    if value is None or value == any_value:
        return df
    return df.where(F.col(col) == F.lit(value))


def exclude_ids(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop rows whose id contains ``pattern``; NULL ids are kept."""
    return df.where(~F.coalesce(F.col(col).contains(pattern), F.lit(False)))


def options(df: DataFrame, var: str, prior_filters: Mapping[str, Sequence | None] | None = None,
            levels: Sequence[str] | None = None) -> DataFrame:
    """Cascading choices (F12): distinct non-null values of ``var`` under earlier choices.

    With ``levels`` returns ``(value, ord)`` in domain order (out-of-domain values are not
    choices); without a codebook returns ``value`` sorted by value (a distributed
    range-partitioned sort, no global numbering).
    """
    d = filter_in(df, prior_filters).where(F.col(var).isNotNull()) \
        .select(F.col(var).alias("value")).distinct()
    if levels is not None:
        return d.withColumn("ord", level_ord("value", levels)).where(F.col("ord").isNotNull()).orderBy("ord")
    return d.orderBy("value")


def options_all(df: DataFrame, cascade: Sequence[tuple[str, Sequence | None]],
                levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All lists of a cascade from one scan (F12, A16): ``step, variable, value, ord, n``.

    ``cascade`` gives the variables in order, each with what is chosen of it (``None``: no
    choice yet).  The list of step k holds the non-null values under the choices of all earlier
    steps.  A row belongs to the lists up to the first filter it fails, so its position says
    which it feeds, and one aggregate over (step, value) answers every list.  Values are text;
    with ``levels`` values outside a variable's domain are no choices and ``ord`` is their
    place in it.  ``n`` is the number of rows behind a choice.
    """
    first = F.lit(len(cascade))
    for k, (var, chosen) in reversed(list(enumerate(cascade))):
        if chosen is not None:
            first = F.when(F.coalesce(F.col(var).isin(list(chosen)), F.lit(False)), first).otherwise(F.lit(k))
    each = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(var).alias("variable"), F.col(var).cast("string").alias("value"))
                     for k, (var, _) in enumerate(cascade)])
    rows = df.select(F.inline(F.filter(each, lambda e: (e["step"] <= first) & e["value"].isNotNull())))
    found = rows.groupBy("step", "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.lit(None).cast("int")
    for var, domain in (levels or {}).items():
        place = F.when(F.col("variable") == var, level_ord("value", domain)).otherwise(place)
    found = found.withColumn("ord", place)
    return found.where(~F.col("variable").isin(list(levels)) | F.col("ord").isNotNull()) if levels else found
