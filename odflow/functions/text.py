"""String helpers for cleaning survey text and labelling results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_parts(cols: Sequence[str | Column], sep: str = " ") -> Column:
    """Join parts with a separator, keeping empty slots for missing parts (``paste`` semantics)."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols])


def blank_to_null_col(c: str | Column) -> Column:
    """Empty string becomes NULL."""
    return F.nullif(_col(c), F.lit(""))


def first_token(c: str | Column) -> Column:
    """Text up to the first space (route number out of a route description)."""
    return F.regexp_replace(_col(c), " .*", "")


def to_number(c: str | Column, dtype: str = "double") -> Column:
    """Tolerant text-to-number cast: unparsable text and ``NaN`` become NULL."""
    number = _col(c).try_cast(dtype)
    return F.when(~F.isnan(number), number)


def remap(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Look a value up in a literal map; values not in the map get ``default`` (or keep NULL)."""
    pairs = []
    for k, v in mapping.items():
        pairs.extend([F.lit(k), F.lit(v)])
    looked = F.try_element_at(F.create_map(*pairs), _col(c))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def transfer_chain(route: str | Column, before: Sequence[str | Column],
                   after: Sequence[str | Column]) -> Column:
    """"route t1 t2 ... u1 u2 ..." with empty text in place of missing transfer codes."""
    return concat_parts([route, *before, *after])


def flow_label(orig: str | Column | None, dest: str | Column, n: str | Column) -> Column:
    """"A to B: n" with n rounded to a whole number, halves to even; "To B: n" without an origin."""
    head = F.lit("To ") if orig is None else F.concat(_col(orig).cast("string"), F.lit(" to "))
    return F.concat(head, _col(dest).cast("string"), F.lit(": "),
                    F.bround(_col(n), 0).cast("bigint").cast("string"))


def percent_text(c: str | Column, digits: int = 1) -> Column:
    """Share in [0, 1] as percent text, e.g. 0.1234 -> "12.3%"."""
    return F.concat(F.format_number(_col(c) * 100, digits), F.lit("%"))


def thousands(c: str | Column, digits: int = 0) -> Column:
    """Number with thousands separators, e.g. 12345.6 -> "12,346"."""
    return F.format_number(_col(c), digits)
