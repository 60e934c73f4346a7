import hashlib
import re

import pytest

from odflow.llm import exact_dedup
from odflow.llm.exact_dedup import exact_duplicates


def norm(t):
    return re.sub("[ \t-\r]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept = ids.index(keep)
        for n, i in enumerate(ids):
            out.append((i, keep, len(ids), n == kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (5, "a b"), (6, "a \r\n b"), (7, "a  b "), (8, "é" * 5000),
        (9, "é" * 5000), (10, "é" * 4999 + "e"), (11, "x" * 40000), (12, "x" * 40001), (13, "x" * 40000),
        (5, "a\tb"), (5, "other"), (None, "lonely"), (None, "a b"), (20, "q" * 8192), (21, "q" * 8192 + " ")]


@pytest.mark.parametrize("block", [3, 4096])
def test_against_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    out = exact_duplicates(docs(ROWS))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(ROWS)


def test_hot_blocks_get_one_name(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    rows = [(i, "same text of three blocks" if i % 2 else f"text number {i}") for i in range(2400)]
    out = exact_duplicates(docs(rows))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def test_empty(docs):
    assert exact_duplicates(docs([])).count() == 0


def test_repeated_ids_with_one_text_keep_one(docs):
    got = [r.kept for r in exact_duplicates(docs([(1, "a"), (1, "a"), (1, "a")])).collect()]
    assert sorted(got) == [False, False, True]
