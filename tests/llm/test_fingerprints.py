import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.llm import fingerprints as fp
from odflow.llm import queries


def brute(text):
    """The digest by its definition, byte by byte."""
    raw = (text or "").encode()
    table, count = fp._TABLE.tolist(), [0] * 256
    at = lambda i: raw[i] if i < len(raw) else 0
    for i in range(len(raw)):
        for k, (a, b) in enumerate(((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))):
            count[table[0][raw[i]] ^ table[2 * k + 1][at(i + a)] ^ table[2 * k + 2][at(i + b)]] += 1
    q1, q2, q3 = (sorted(count)[k] for k in (63, 127, 191))
    code = [(c > q1) + (c > q2) + (c > q3) for c in count]
    head = [min(255, math.floor(8 * math.log2(len(raw) + 1))),
            min(15, 16 * q1 // max(q3, 1)) << 4 | min(15, 16 * q2 // max(q3, 1))]
    body = [code[i] | code[i + 1] << 2 | code[i + 2] << 4 | code[i + 3] << 6 for i in range(0, 256, 4)]
    return bytes(head + body).hex()


def like(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    codes = lambda z: [c >> s & 3 for c in z[2:] for s in (0, 2, 4, 6)]
    total = sum((0, 1, 2, 6)[abs(p - q)] for p, q in zip(codes(x), codes(y)))
    total += abs(x[0] - y[0]) + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
    return max(0.0, 1 - total / 416)


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdeéñ漢😀 ijklmno") for _ in range(rng.randrange(1, 9))) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    base = [prose(rng, rng.choice([0, 1, 2, 5, 40, 300])) for _ in range(80)]
    return list(enumerate([*base, base[5], "x", "xy", "xyz", "wxyz", "vwxyz", "", None, "\n", "a" * 5000]))


def test_digest_equals_definition(docs, texts):
    got = {r["doc_id"]: r for r in fp.fingerprints(docs(texts)).collect()}
    for i, t in texts:
        assert got[i]["fingerprint"] == brute(t)
        assert got[i]["n_chars"] == len(t or "")
    assert got[5]["fingerprint"] == got[80]["fingerprint"]


def test_likeness_column(spark):
    rng = random.Random(4)
    marks = [brute(prose(rng, 50)) for _ in range(20)]
    rows = [(a, b) for a in marks for b in marks] + [(None, marks[0]), (marks[0], None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    for a, b, got in df.select("a", "b", fp.likeness("a", "b").alias("x")).collect():
        assert got == (None if a is None or b is None else pytest.approx(like(a, b)))
        assert a is None or a != b or got == 1.0


def test_chunks_make_no_difference(monkeypatch):
    raw = np.frombuffer(prose(random.Random(6), 3000).encode(), np.uint8)
    whole, cuts = fp.digest([raw]), [fp._cut(raw, k) for k in range(0, 4000, 37)]
    monkeypatch.setattr(fp, "_CHUNK", 1000)
    assert (fp.digest([raw]) == whole).all()
    assert [fp._cut(raw, k) for k in range(0, 4000, 37)] == cuts


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[:len(t) - m] + after[:m]
        marks = brute(t), brute(edited), brute(after)
        yield i, (len(t), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
                  pytest.approx(like(marks[0], marks[1])), pytest.approx(like(marks[0], marks[2])))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_edited_texts_equal_brute_force(spark, docs, texts, partitions):
    rows = [*texts, (None, "no id")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in fp.edited_fingerprints(docs(rows).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = dict(expected(rows))
    assert got.keys() == want.keys()
    assert all(got[i] == want[i] for i in want)


def test_few_rows_and_repeated_rows(docs):
    one = fp.edited_fingerprints(docs([(7, "abcdef")])).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in one] == [(1.0, hashlib.sha256(b"abcdab").hexdigest())]
    same = fp.edited_fingerprints(docs([(1, "abc" * 50)] * 6 + [(None, None)] * 3))
    assert same.count() == 9
    assert same.where("near_next = 1").count() == 5 + 2
    assert fp.edited_fingerprints(docs([(1, "a")]).limit(0)).count() == 0
    assert fp.fingerprints(docs([(1, "a")]).limit(0)).count() == 0


def test_clashing_columns_and_text_ids(spark):
    df = spark.createDataFrame([("b", "hello world", 1, "h"), ("a", "other words", 2, "t")],
                               "fingerprint string, digest string, n_chars int, tie string")
    got = {r["fingerprint"]: r["n_chars"] for r in
           fp.edited_fingerprints(df, "fingerprint", "digest").select(F.col("n_chars"), F.col("edited_sha256")).collect()
           for r in [dict(fingerprint=r["edited_sha256"], n_chars=r["n_chars"])]}
    assert got == {hashlib.sha256(b"hello wooth").hexdigest(): 11, hashlib.sha256(b"other wohel").hexdigest(): 11}


def test_query_tells_edits_from_other_texts(spark):
    out = queries.op13(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = out.where("n_chars >= 50").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)
