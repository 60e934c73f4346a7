"""Survey composites: the cross-tab report (Q1) and the preparation batch (Q9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.operators.clean import apply_overrides, blank_to_null
from odflow.operators.codebook import apply_codebook, collapse_flags, label_of, level_ord
from odflow.operators.crosstab import add_share, crosstab, sample_keys
from odflow.operators.filters import exclude_ids
from odflow.operators.joins import attach_route_type, attach_weights


def crosstab_report(trips: DataFrame, x: str | None = None, y: str | None = None,
                    facet: str | None = None,
                    filters: Mapping[str, Sequence | None] | None = None,
                    linked: bool = False, domains: Mapping[str, Sequence[str]] | None = None,
                    labels: Mapping[str, Mapping[str, str]] | None = None, min_obs: int = 30,
                    w: str = "w", m: str = "m") -> DataFrame:
    """Cross-tab with shares, domain ordinals, labels and the small-sample flag (Q1).

    ``small`` marks rows whose group - the row itself, or its x (and facet) total as in the
    warning of the reference - has fewer than ``min_obs`` observations.  All steps run on
    the cross-tab, whose size is the product of the category counts.
    """
    xt = crosstab(trips, x, y, facet, filters=filters, linked=linked, domains=domains, w=w, m=m)
    out = add_share(xt, x, y, facet)
    keys = [v for v in dict.fromkeys([x, y, facet]) if v is not None]
    if x is None or y is None or x == y:
        out = out.withColumn("small", F.col("obs") < min_obs)
    else:
        group = Window.partitionBy(*sample_keys(x, y, facet))
        out = out.withColumn("small", F.sum("obs").over(group) < min_obs)
    for v, lv in (domains or {}).items():
        if v in keys:
            out = out.withColumn(f"{v}_ord", level_ord(v, lv))
    for v, lab in (labels or {}).items():
        if v in keys:
            out = label_of(out, v, lab)
    return out


def prepare_survey(raw: DataFrame, key: str, weights: DataFrame | None = None,
                   route_text: str | None = None, route_classes: DataFrame | None = None,
                   named_routes: Sequence[str] = (), renamed_routes: Mapping[str, str] | None = None,
                   flag_sets: Mapping[str, tuple[Mapping[str, str], str, str | None]] | None = None,
                   codebook: Mapping[str, Sequence[str]] | None = None,
                   overrides: DataFrame | None = None, override_cols: Sequence[str] = (),
                   exclude_pattern: str | None = None) -> DataFrame:
    """Raw survey rows to the prepared trip table (Q9), one pass per output table.

    Order of the reference batch: weights by record id (J1) -> multi-select answers
    collapsed (C3, evaluated before blanks become NULL, as there) -> blank to NULL (P2) ->
    route number and class (J2) -> ordered domains (C1) -> manual corrections (P12) ->
    excluded ids (P13).  ``flag_sets`` maps an output column to ``(flags, many, other_col)``.
    """
    df = raw if weights is None else attach_weights(raw, weights, key)
    for out, (flags, many, other) in (flag_sets or {}).items():
        df = collapse_flags(df, flags, many=many, out=out, other_col=None)
        if other is not None:
            other_present = F.nullif(F.col(other), F.lit("")).isNotNull()
            df = df.withColumn(out, F.when(F.col(out).isNull() & other_present,
                                           F.lit("Other")).otherwise(F.col(out)))
    df = blank_to_null(df)
    if route_text is not None and route_classes is not None:
        df = attach_route_type(df, route_classes, route_text=route_text,
                               named=named_routes, renamed=renamed_routes)
    if codebook:
        df = apply_codebook(df, codebook)
    if overrides is not None and override_cols:
        df = apply_overrides(df, overrides, key, override_cols)
    if exclude_pattern is not None:
        df = exclude_ids(df, key, exclude_pattern)
    return df
