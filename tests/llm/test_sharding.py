import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from odflow.llm import sharding
from odflow.llm.sharding import difference, shard_documents


def test_known_two_way_case():
    # Differencing of 8 7 6 5 4 leaves a difference of 2 (the best is 0).
    part = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert abs(np.bincount(part, [8, 7, 6, 5, 4], 2) @ [1, -1]) == 2


@pytest.mark.parametrize("k", [2, 3])
def test_never_far_from_the_best_split(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        sizes = rng.integers(1, 50, 8)
        best = min(np.ptp(np.bincount(p, sizes, k)) for p in itertools.product(range(k), repeat=8))
        got = np.ptp(np.bincount(difference(sizes, k), sizes, k))
        assert got <= best + sizes.max() / 2


def check(rows, out, shards):
    got = [tuple(r) for r in out.collect()]
    key = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t in rows)
    assert Counter((g[0], g[1], g[2], g[3], g[6]) for g in got) == key
    for s in range(shards):
        slots = sorted(g[5] for g in got if g[4] == s)
        assert slots == list(range(len(slots)))
    where = {}
    for g in got:
        assert 0 <= g[4] < shards and where.setdefault((g[1], g[2]), g[4]) == g[4]
    return np.bincount([g[4] for g in got], [g[1] for g in got], shards)


def test_documents(docs):
    rng = np.random.default_rng(4)
    rows = [(int(i), "x" * int(n) + str(i)) for i, n in enumerate(rng.lognormal(4, 1, 900))]
    rows += [(i, "copy " * 9) for i in range(2000, 2040)] + [(1, None), (None, ""), (7, "é"), (7, "é"), (8, "L" * 3000)]
    load = check(rows, shard_documents(docs(rows)), 16)
    assert np.ptp(load) <= 2


def test_levels_agree_with_one_heap(docs, monkeypatch):
    monkeypatch.setattr(sharding, "TOP", 120)
    monkeypatch.setattr(sharding, "CHUNK", 100)
    monkeypatch.setattr(sharding, "BUNDLES", 4)
    monkeypatch.setattr(sharding, "FINE", 30)
    monkeypatch.setattr(sharding, "LARGE", 50)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(int(i), "y" * int(n) + str(i)) for i, n in enumerate(rng.lognormal(4, 1, 1500))]
    rows += [(i, "giant" * 400) for i in range(5000, 5003)]
    load = check(rows, shard_documents(docs(rows), 8), 8)
    assert np.ptp(load) <= 0.01 * load.mean()


def test_empty_and_single(docs):
    assert shard_documents(docs([])).count() == 0
    assert check([(1, "a")], shard_documents(docs([(1, "a")])), 16).sum() == 2


def test_slots_follow_the_mix(spark, docs, monkeypatch):
    """Copies of one document lie apart: a shard's slots are in the order that mix gave."""
    from odflow.llm.mixing import mix

    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rows = docs([(i, f"text {i}") for i in range(40)], source="small").unionByName(
        docs([(1000 + i, "word " * (i % 7)) for i in range(400)], source="big"))
    mixed = mix(rows, weights={"small": 5.0, "big": 1.0})
    order = {}
    for r in mixed.collect():
        order.setdefault((r.doc_id, zlib.crc32(r.text.encode())), []).append(r["__order"])
    out = shard_documents(mixed.drop("__copy", "__order"), 2, order_seed="mix").orderBy("shard", "slot").collect()
    assert len(out) == sum(map(len, order.values()))
    neighbours = 0
    for s in range(2):
        mine = [r for r in out if r.shard == s]
        assert [r.slot for r in mine] == list(range(len(mine)))
        want = sorted((o, k) for k in {(r.doc_id, r.text_crc32) for r in mine} for o in order[k])
        assert [(r.doc_id, r.text_crc32) for r in mine] == [k for _, k in want]
        neighbours += sum(a.doc_id == b.doc_id for a, b in zip(mine, mine[1:]))
    assert neighbours < len(out) / 5
