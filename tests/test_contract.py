"""Static guards: the registry is complete and the library stays on built-in Spark."""

import pathlib
import re

import __spark_entry__ as entry
from odflow.plans.queries import ORACLE, QUERIES

PKG = pathlib.Path(__file__).resolve().parent.parent / "odflow"


def test_every_query_has_docstring_and_oracle():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) >= 40
    q, o = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and set(o) <= set(q)
    assert all((fn.__doc__ or "").strip() for fn in q.values())


def test_library_uses_no_udf_rdd_or_local_checkpoint():
    # Driver-side collects exist only for scalars (cell size, bounds, two order statistics).
    banned = [r"\blocalCheckpoint\b", r"\budf\(", r"pandas_udf", r"\.rdd\b", r"mapPartitions",
              r"sparkContext\.parallelize"]
    hits = []
    for f in PKG.rglob("*.py"):
        if "llm" in f.parts:
            continue
        for n, line in enumerate(f.read_text().splitlines(), 1):
            if any(re.search(b, line) for b in banned):
                hits.append(f"{f.name}:{n}: {line.strip()}")
    assert hits == []
