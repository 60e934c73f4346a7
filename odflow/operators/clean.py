"""Table-level cleaning helpers."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Empty strings become NULL in every (or the listed) string column."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in names})


def cols_like(df: DataFrame, pattern: str) -> list[str]:
    """Column names matching a glob-style pattern."""
    return [c for c in df.columns if fnmatch.fnmatchcase(c, pattern)]


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Contiguous range of columns, both ends included."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[i:j + 1]


def map_cols(df: DataFrame, cols: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """Apply one column function to a set of columns."""
    return df.withColumns({c: f(F.col(c)) for c in cols})


def assign_rules(df: DataFrame, col: str, rules: Sequence[tuple[Column, object]],
                 keep_existing: bool = True) -> DataFrame:
    """Conditional updates applied in order, the last matching rule wins (P10).

    Built as one ``CASE WHEN`` with the rules reversed; rows no rule matches keep their
    value (or get NULL when the column is new or ``keep_existing`` is False).
    """
    base = F.col(col) if keep_existing and col in df.columns else F.lit(None)
    expr = None
    for cond, value in reversed(list(rules)):
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return df.withColumn(col, base if expr is None else expr.otherwise(base))


def direction_of(c: str | Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Travel direction code (NB/SB/EB/WB) from a route description.

    The code in square brackets wins; descriptions without one are looked up in
    ``exceptions`` (e.g. lines written out as "Northbound").
    """
    c = F.col(c) if isinstance(c, str) else c
    code = F.nullif(F.regexp_extract(c, r"\[([NSEW]B)\]", 1), F.lit(""))
    if exceptions:
        pairs = []
        for k, v in exceptions.items():
            pairs.extend([F.lit(k), F.lit(v)])
        code = F.coalesce(code, F.try_element_at(F.create_map(*pairs), c))
    return code


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str,
                    cols: Sequence[str]) -> DataFrame:
    """Manual corrections of single records by key (P12): override values win when present."""
    o = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    out = df.join(o, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c in cols}) \
        .drop(*[f"_o_{c}" for c in cols])
