"""Ordered categorical domains (C1-C4) and multi-select answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.operators.quantile import global_rank


def level_map(levels: Sequence[str]) -> Column:
    """Literal map ``level -> ordinal`` (1-based) for one variable."""
    pairs = []
    for i, lvl in enumerate(levels, 1):
        pairs.extend([F.lit(lvl), F.lit(i)])
    return F.create_map(*pairs)


def level_ord(c: str | Column, levels: Sequence[str]) -> Column:
    """Ordinal of a value in its domain; NULL for NULL or out-of-domain values."""
    return F.try_element_at(level_map(levels), F.col(c) if isinstance(c, str) else c)


def apply_codebook(df: DataFrame, codebook: Mapping[str, Sequence[str]],
                   ord_suffix: str = "_ord") -> DataFrame:
    """Restrict each listed column to its ordered domain.

    Values outside the domain become NULL (R ``factor``); ``<col><ord_suffix>`` keeps the
    ordinal so results can be sorted in domain order.  A literal map per variable - no
    join, no shuffle.
    """
    cols = {}
    for var, levels in codebook.items():
        o = level_ord(var, levels)
        cols[f"{var}{ord_suffix}"] = o
        cols[var] = F.when(o.isNotNull(), F.col(var))
    # ordinals first: they read the original value
    out = df.withColumns({k: v for k, v in cols.items() if k.endswith(ord_suffix)})
    return out.withColumns({k: v for k, v in cols.items() if not k.endswith(ord_suffix)})


def infer_domain(df: DataFrame, col: str) -> DataFrame:
    """Sorted domain of a column from the data: ``(value, ord)``, ``ord`` from 1.

    The distinct values are numbered by a distributed rank, so a domain of any size does.
    """
    d = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return global_rank(d, ["value"], out="ord").withColumn("ord", F.col("ord").cast("int"))


def order_by_levels(df: DataFrame, cols: Sequence[str], ord_suffix: str = "_ord") -> DataFrame:
    """Order by domain ordinals, NULLs last (O1)."""
    return df.orderBy(*[F.asc_nulls_last(f"{c}{ord_suffix}") for c in cols])


def collapse_flags(df: DataFrame, flags: Mapping[str, str], many: str, out: str,
                   other_col: str | None = None, other_label: str = "Other",
                   yes: str = "Yes") -> DataFrame:
    """Collapse several Yes/No answers into one category (C3 with the row count A12).

    none set -> NULL; exactly one -> its label; several -> ``many``.  When ``other_col`` is
    given, rows still NULL whose free-text column is present become ``other_label``.
    """
    is_yes = {c: F.coalesce(F.col(c) == F.lit(yes), F.lit(False)) for c in flags}
    n = sum((F.when(v, 1).otherwise(0) for v in is_yes.values()), F.lit(0))
    single = F.coalesce(*[F.when(is_yes[c], F.lit(label)) for c, label in flags.items()])
    res = F.when(n > 1, F.lit(many)).when(n == 1, single)
    if other_col is not None:
        res = F.when(res.isNull() & F.col(other_col).isNotNull(), F.lit(other_label)) \
               .otherwise(res)
    return df.withColumn(out, res)


def label_of(df: DataFrame, col: str, labels: Mapping[str, str], out: str | None = None
             ) -> DataFrame:
    """Code-to-label lookup for one variable (P17) from a literal map; unknown codes keep NULL."""
    pairs = []
    for k, v in labels.items():
        pairs.extend([F.lit(k), F.lit(v)])
    return df.withColumn(out or f"{col}_label", F.try_element_at(F.create_map(*pairs), F.col(col)))
