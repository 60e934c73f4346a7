import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from odflow.llm import queries
from odflow.llm._lce import COVER, MODULUS, Extensions
from odflow.llm.periodic_runs import periodic_runs, word_runs


def brute(w):
    """Runs by the definition: all maximal stretches of every period, least period first."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequence(rng):
    n, k = rng.choice([0, 1, 3, 6, 10, 30, 80, 200]), rng.choice([1, 2, 3, 10])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n > 10 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def found(df, key="doc_id"):
    return {r[key]: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in df.collect()}


def test_cover_meets_every_difference():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_extensions_equal_direct_comparison():
    rng = random.Random(3)
    words, text = [], []
    for t in range(12):
        part = [rng.randrange(1, 3) for _ in range(rng.randrange(1, 60))] * rng.choice([1, 4])
        words += [*part, 0]
        text += [t] * (len(part) + 1)
    w, t = np.array(words, np.uint64), np.array(text)
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w)) if t[i] == t[j]]
    i, j = (np.array(x) for x in zip(*rng.sample(pairs, 3000)))
    for a, b, got in zip(i, j, Extensions(w, t).lce(i, j)):
        want = 0
        while w[a + want] == w[b + want]:
            want += 1
        assert got == want


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        seqs = [sequence(rng) for _ in range(rng.choice([1, 5, 30]))]
        words = np.array([int(x[1:]) + 1 for s in seqs for x in s], np.uint64)
        first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
        got = [[] for _ in seqs]
        for t, *run in zip(*word_runs(words, first)):
            got[t].append(tuple(int(x) for x in run))
        assert got == [brute(s) for s in seqs]


def test_texts_and_collapsed_words(docs):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        w = sequence(rng)
        rows.append((i, "".join(rng.choice(["\n", " ", "\t \r", ""] if not k else ["\n", " ", "\t \r\n"]) + x
                                for k, x in enumerate(w)) + rng.choice(["", " "])))
    got = found(periodic_runs(docs(rows)))
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        assert got[i] == (brute(w), collapsed(w, brute(w)), len(w))


def test_defined_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "a a a a a"),
            (5, "A a A a A a A a"), (6, "\xa0 x \xa0 x \xa0 x \xa0 x"), (7, "Ä b Ä b Ä b Ä B")]
    out = periodic_runs(docs(rows)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    for i in (1, 2, 3):
        assert (got[i]["runs"], got[i]["collapsed"], got[i]["n_words"]) == ([], "", 0)
    assert [tuple(x) for x in got[4]["runs"]] == [(0, 6, 1)] and got[4]["collapsed"] == "a"
    assert got[None]["runs"] == [] and got[None]["collapsed"] == "a a a a a"
    assert [tuple(x) for x in got[5]["runs"]] == [(0, 8, 2)]
    assert [tuple(x) for x in got[6]["runs"]] == [(0, 8, 2)]  # no-break space is a word's byte
    assert got[7]["runs"] == []
    assert periodic_runs(docs(rows).limit(0)).count() == 0


def test_clashing_columns_and_text_ids(spark):
    df = spark.createDataFrame([("k", "x x x x x x x", [1], "r")], "name string, runs string, id array<int>, collapsed string")
    assert found(periodic_runs(df, "name", "runs"), "name") == {"k": ([(0, 7, 1)], "x", 7)}


def test_very_long_text(docs):
    w = [f"v{i % 997}" for i in range(150_000)]
    got = found(periodic_runs(docs([(1, " ".join(w)), (2, "y" * 3_000_000)])))
    assert got[1][0] == [(0, 150_000, 997)] and got[1][1] == " ".join(w[:997])
    assert got[2][0] == [] and len(got[2][1]) == 3_000_000


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, " ".join(sequence(rng))) for i in range(400)] + [(400, None), (401, ""), (None, "q q q q q q q")]
    path = tmp_path_factory.mktemp("runs")
    (spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(path / "documents.parquet")))
    return str(path), rows


def test_query_equals_brute_force(spark, fixture_dir):
    path, rows = fixture_dir
    got = {r["doc_id"]: r for r in queries.op11(spark, path).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        w = (t or "").split()
        if i is not None and w:
            h, n = zlib.crc32(str(i).encode()), len(w)
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
                planted += 1
        runs, r = brute(w), got[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 20
