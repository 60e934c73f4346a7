"""Registered survey queries (Q1: A1, F1, F2, W1, F10, F12, A7, C1, C3, O1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.operators.codebook import apply_codebook, collapse_flags
from odflow.operators.crosstab import add_share, crosstab, frequency, small_samples
from odflow.operators.filters import options
from odflow.plans import oracle as O
from odflow.plans.catalog import register, rsql, trips
from odflow.plans.survey import crosstab_report, prepare_survey
from odflow.sources.views import driver_table

# Codebook of the stand-in survey variables (ordered domains).
DOMAINS = {
    "time_period": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"],
    "segment": ["MACHINERY", "AUTOMOBILE", "BUILDING", "HOUSEHOLD"],
    "flag": ["R", "A", "N"],
}
NA_SUM_W = "CASE WHEN COUNT(w) = COUNT(*) THEN SUM(w) END"
NA_SUM_WM = "CASE WHEN COUNT(w * m) = COUNT(*) THEN SUM(w * m) END"


def _where(filters: dict, facets: list[str]) -> str:
    conds = [f"{c} IN {O.in_list(v)}" for c, v in filters.items() if c not in facets]
    conds += [f"{c} IN {O.in_list(DOMAINS[c])}" for c in facets if c in DOMAINS]
    return " AND ".join(conds) if conds else "TRUE"


def _xtab_sql(facets: list[str], filters: dict, linked: bool) -> str:
    keys = ", ".join(facets)
    return (f"SELECT {keys + ', ' if keys else ''}COUNT(*) AS obs, "
            f"{NA_SUM_WM if linked else NA_SUM_W} AS N FROM trip "
            f"WHERE {_where(filters, facets)}" + (f" GROUP BY {keys}" if keys else ""))


def _xtab_query(facets, filters, linked):
    sql = f"{O.views('trip')}, x AS ({_xtab_sql(facets, filters, linked)})\n" \
          f"SELECT {', '.join(facets) + ', ' if facets else ''}obs, {rsql('N')} FROM x"
    return sql


X1 = (["segment"], {"route": list(range(0, 10)), "time_period": DOMAINS["time_period"][:3]}, False)
X2 = (["segment", "time_period"], {"route": list(range(5, 15))}, True)
X3 = (["segment", "time_period", "flag"], {"route_type": ["SMALL", "LARGE", "PROMO"]}, False)


def _xt(spark, sf_dir, spec):
    facets, filters, linked = spec
    x, y, facet = (facets + [None, None, None])[:3]
    return crosstab(trips(spark, sf_dir), x, y, facet, filters=filters, linked=linked,
                    domains=DOMAINS)


@register("crosstab_1", _xtab_query(*X1))
def q_crosstab_1(spark, sf_dir):
    """Weighted cross-tab of one variable under two IN-list filters (A1, F1, F2)."""
    return _xt(spark, sf_dir, X1)


@register("crosstab_2", _xtab_query(*X2))
def q_crosstab_2(spark, sf_dir):
    """Two-variable cross-tab with linked weights; missing weights give a NULL N (A1)."""
    return _xt(spark, sf_dir, X2)


@register("crosstab_3", _xtab_query(*X3))
def q_crosstab_3(spark, sf_dir):
    """Three-variable cross-tab (x, y, facet) (A1)."""
    return _xt(spark, sf_dir, X3)


def _share_sql(spec, parts: list[str] | None) -> str:
    facets, filters, linked = spec
    x = _xtab_sql(facets, filters, linked)
    if parts:
        over = f"OVER (PARTITION BY {', '.join(parts)})"
        tot = f"CASE WHEN COUNT(N) {over} = COUNT(*) {over} THEN SUM(N) {over} END"
        body = f"SELECT *, N / ({tot}) AS share FROM x"
    else:
        body = ("SELECT x.*, N / t.total AS share FROM x CROSS JOIN "
                "(SELECT CASE WHEN COUNT(N) = COUNT(*) THEN SUM(N) END AS total FROM x) t")
    return (f"{O.views('trip')}, x AS ({x}), s AS ({body})\n"
            f"SELECT {', '.join(facets)}, obs, {rsql('N')}, {rsql('share')} FROM s")


S_ALL = (["segment"], {"route": list(range(0, 10))}, True)


@register("crosstab_share_x", _share_sql(X2, ["segment"]))
def q_crosstab_share_x(spark, sf_dir):
    """Share of N within x for an x-by-y table."""
    return add_share(_xt(spark, sf_dir, X2), "segment", "time_period")


@register("crosstab_share_xf", _share_sql(X3, ["segment", "flag"]))
def q_crosstab_share_xf(spark, sf_dir):
    """Share of N within (x, facet) for an x-by-y-by-facet table."""
    return add_share(_xt(spark, sf_dir, X3), "segment", "time_period", "flag")


@register("crosstab_share_all", _share_sql(S_ALL, None))
def q_crosstab_share_all(spark, sf_dir):
    """Share of N over the whole one-variable table (W1, overall total broadcast)."""
    return add_share(_xt(spark, sf_dir, S_ALL), "segment")


SMALL = (["time_period", "segment", "flag"], {"route": [3], "route_type": ["SMALL"]}, False)


@register("small_samples", f"""{O.views('trip')}, x AS ({_xtab_sql(*SMALL)})
SELECT time_period, flag, CAST(SUM(obs) AS BIGINT) AS obs FROM x GROUP BY time_period, flag
HAVING SUM(obs) < 30""")
def q_small_samples(spark, sf_dir):
    """(x, facet) groups with fewer than 30 observations."""
    xt = _xt(spark, sf_dir, SMALL)
    return small_samples(xt, "time_period", "segment", "flag", n=30)


OPT_PRIOR = {"route": [1, 2, 3], "segment": ["BUILDING", "MACHINERY"],
             "time_period": ["2-HIGH", "3-MEDIUM"]}


@register("options_cascade", f"""{O.views('trip')}
SELECT value, ord FROM (SELECT DISTINCT flag AS value FROM trip
  WHERE route IN {O.in_list(OPT_PRIOR['route'])} AND segment IN {O.in_list(OPT_PRIOR['segment'])}
  AND time_period IN {O.in_list(OPT_PRIOR['time_period'])} AND flag IS NOT NULL) d
JOIN (SELECT * FROM (VALUES ('R', 1), ('A', 2), ('N', 3)) v(lvl, ord)) l ON l.lvl = d.value""")
def q_options_cascade(spark, sf_dir):
    """Choices left for a variable under earlier choices, in domain order."""
    return options(trips(spark, sf_dir), "flag", OPT_PRIOR, levels=DOMAINS["flag"])


@register("options_unordered", f"""{O.views('trip')}
SELECT DISTINCT route_type AS value FROM trip WHERE route IN (4, 5) AND route_type IS NOT NULL""")
def q_options_unordered(spark, sf_dir):
    """Choices of a variable without a codebook, distinct and sorted."""
    return options(trips(spark, sf_dir), "route_type", {"route": [4, 5]})


@register("frequency", f"""{O.views('trip')}
SELECT route_type, COUNT(*) AS n FROM trip WHERE route_type IS NOT NULL GROUP BY route_type""")
def q_frequency(spark, sf_dir):
    """Frequency table of a column, nulls excluded, ascending."""
    return frequency(trips(spark, sf_dir), "route_type")


FLAGS = {"sel_a": "Returned", "sel_b": "Open", "sel_c": "Large"}


@register("collapse_flags", f"""{O.views('trip')}, c AS (
  SELECT *, (CASE WHEN sel_a = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN sel_b = 'Yes' THEN 1 ELSE 0 END)
          + (CASE WHEN sel_c = 'Yes' THEN 1 ELSE 0 END) AS n FROM trip),
k AS (SELECT CASE WHEN n > 1 THEN 'Multiple'
                  WHEN n = 1 AND sel_a = 'Yes' THEN 'Returned'
                  WHEN n = 1 AND sel_b = 'Yes' THEN 'Open'
                  WHEN n = 1 AND sel_c = 'Yes' THEN 'Large'
                  WHEN time_period IS NOT NULL THEN 'Other' END AS category FROM c)
SELECT category, COUNT(*) AS n FROM k GROUP BY category""")
def q_collapse_flags(spark, sf_dir):
    """Several Yes/No answers collapsed into one category with an "Other" fill."""
    t = collapse_flags(trips(spark, sf_dir), FLAGS, many="Multiple", out="category",
                       other_col="time_period")
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


ORDER_CODEBOOK = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"],
                  "o_orderstatus": ["O", "F"]}


@register("apply_codebook", """SELECT o_orderkey,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS o_orderpriority,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS o_orderpriority_ord,
  CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS o_orderstatus,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS o_orderstatus_ord
FROM orders""")
def q_apply_codebook(spark, sf_dir):
    """Columns restricted to ordered domains with their ordinals."""
    o = driver_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority",
                                                     "o_orderstatus")
    return apply_codebook(o, ORDER_CODEBOOK)


X0 = ([], {"route": list(range(3, 12)), "flag": ["R", "A"]}, True)


@register("crosstab_0", _xtab_query(*X0))
def q_crosstab_0(spark, sf_dir):
    """Cross-tab of no variable: one row with the filtered sample size and weight (A1)."""
    return _xt(spark, sf_dir, X0)


# Display labels of the stand-in flag codes.
FLAG_LABELS = {"R": "Returned", "A": "Accepted", "N": "Not returned"}


@register("crosstab_report", f"""{O.views('trip')}, x AS ({_xtab_sql(*SMALL)}),
s AS (SELECT *, N / (CASE WHEN COUNT(N) OVER (PARTITION BY time_period, flag) = COUNT(*) OVER (PARTITION BY time_period, flag)
                     THEN SUM(N) OVER (PARTITION BY time_period, flag) END) AS share FROM x),
g AS (SELECT time_period, flag FROM x GROUP BY time_period, flag HAVING SUM(obs) < 30)
SELECT s.time_period, s.segment, s.flag, s.obs, {rsql('s.N', 'N')}, {rsql('s.share', 'share')},
  (g.flag IS NOT NULL) AS small,
  CASE s.time_period WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS time_period_ord,
  CASE s.segment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 3 WHEN 'HOUSEHOLD' THEN 4 END AS segment_ord,
  CASE s.flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 END AS flag_ord,
  CASE s.flag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Not returned' END AS flag_label
FROM s LEFT JOIN g ON g.time_period = s.time_period AND g.flag = s.flag""")
def q_crosstab_report(spark, sf_dir):
    """Cross-tab with shares, ordinals, labels and small-sample flags (Q1)."""
    facets, filters, linked = SMALL
    return crosstab_report(trips(spark, sf_dir), "time_period", "segment", "flag",
                           filters=filters, linked=linked, domains=DOMAINS,
                           labels={"flag": FLAG_LABELS})


_RAW_SQL = """SELECT CAST(l_orderkey AS {s}) AS ID, l_linenumber, l_partkey, l_extendedprice,
  sel_a, sel_b, sel_c, time_period, segment,
  CAST(route AS {s}) || ' ' || segment AS ROUTE_SURVEYED FROM trip"""


@register("prepare_survey", f"""{O.views('trip')},
raw AS ({_RAW_SQL.format(s='VARCHAR')}),
wt AS (SELECT CAST(o_orderkey AS VARCHAR) AS ID, o_totalprice AS weight FROM orders),
j AS (SELECT raw.*, wt.weight FROM raw LEFT JOIN wt ON wt.ID = raw.ID),
c AS (SELECT *, (CASE WHEN sel_a = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN sel_b = 'Yes' THEN 1 ELSE 0 END)
              + (CASE WHEN sel_c = 'Yes' THEN 1 ELSE 0 END) AS n FROM j),
k AS (SELECT *, CASE WHEN n > 1 THEN 'Multiple' WHEN n = 1 AND sel_a = 'Yes' THEN 'Returned'
                     WHEN n = 1 AND sel_b = 'Yes' THEN 'Open' WHEN n = 1 AND sel_c = 'Yes' THEN 'Large'
                     WHEN NULLIF(time_period, '') IS NOT NULL THEN 'Other' END AS category,
             regexp_replace(ROUTE_SURVEYED, ' .*', '') AS route FROM c)
SELECT k.ID, k.l_linenumber, k.l_partkey, {rsql('k.l_extendedprice', 'l_extendedprice')}, {rsql('k.weight', 'weight')},
  k.category, NULLIF(k.sel_a, '') AS sel_a, k.route,
  CASE WHEN k.route = '7' THEN 'Harbour boat' ELSE p.p_type END AS RouteType,
  CASE WHEN k.time_period IN {O.in_list(DOMAINS['time_period'])} THEN k.time_period END AS time_period,
  CASE k.time_period WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS time_period_ord,
  CASE WHEN k.segment IN {O.in_list(DOMAINS['segment'])} THEN k.segment END AS segment,
  CASE k.segment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 3 WHEN 'HOUSEHOLD' THEN 4 END AS segment_ord
FROM k LEFT JOIN part p ON CAST(p.p_partkey AS DOUBLE) = TRY_CAST(k.route AS DOUBLE)
WHERE NOT COALESCE(k.ID LIKE '%7%', FALSE)""")
def q_prepare_survey(spark, sf_dir):
    """Preparation batch: weights, flag collapse, blanks, route class, codebook, exclusions (Q9)."""
    raw = spark.sql(_RAW_SQL.format(s="STRING").replace("FROM trip", "FROM {trip}"),
                    trip=trips(spark, sf_dir))
    weights = driver_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("ID"), F.col("o_totalprice").alias("weight"))
    classes = driver_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Route"), F.col("p_type").alias("RouteType"))
    prep = prepare_survey(
        raw, "ID", weights=weights, route_text="ROUTE_SURVEYED", route_classes=classes,
        renamed_routes={"7": "Harbour boat"},
        flag_sets={"category": (FLAGS, "Multiple", "time_period")},
        codebook={"time_period": DOMAINS["time_period"], "segment": DOMAINS["segment"]},
        exclude_pattern="7")
    return prep.select("ID", "l_linenumber", "l_partkey", "l_extendedprice", "weight", "category",
                       "sel_a", "route", "RouteType", "time_period", "time_period_ord",
                       "segment", "segment_ord")
