import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odflow.llm import toxicity
from odflow.llm.queries import held_out


def corpus(n, seed, langs=("en", "de")):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    bad = {"en": ["nasty", "vilest", "rotten"], "de": ["zorqux" + x for x in ("ei", "un", "ab", "er", "heit")]}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(langs)
        t = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        y = int(rng.random() < 0.25)
        for _ in range(rng.randint(1, 4) if y else 0):
            t.insert(rng.randrange(len(t) + 1), rng.choice(bad[lang]).title())
        rows.append((i, " ".join(t) + ".", lang))
        labels.append((i, y))
    return rows, labels


SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(1600, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    return docs, lab, toxicity.fit(docs, lab.where(~held_out()))


def test_held_out_accuracy(fitted):
    docs, lab, model = fitted
    out = toxicity.score_toxicity(docs, model).join(lab.dropna(), "doc_id").where(held_out()).collect()
    score, y = np.array([r.score for r in out]), np.array([r.toxic for r in out])
    assert len(out) > 200 and ((score >= 0.3) == y).mean() > 0.97
    assert np.mean([r.rejected == (r.toxic == 1) for r in out]) > 0.97
    assert model.thresholds and set(model.thresholds) <= {"en", "de"}


def test_pooling_is_brute_force_convolution(fitted, monkeypatch):
    _, _, model = fitted
    texts = ["", "one", "nasty word here", "a b " * 40, "x " * 500 + "nasty vilest", "tail rotten"]
    rows, first = toxicity.buckets(pa.array(texts))
    want = np.zeros((len(texts), len(toxicity.WIDTHS) * toxicity.FILTERS))
    for t in range(len(texts)):
        x = sum(model.table[rows[first[t]:first[t + 1], j]] for j in range(4)).astype(float)
        if len(x):
            x = np.vstack([x, np.zeros((2, toxicity.DIM))])
            for k, w in enumerate(model.filters):
                r = np.array([sum(x[i + j] @ w[j] for j in range(len(w))) for i in range(len(x) - 2)])
                want[t, k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS] = r.max(axis=0)
    assert np.allclose(model.pooled(rows, first), want, atol=1e-4)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", size)
        assert np.allclose(model.pooled(rows, first), want, atol=1e-4)


def test_score_sees_the_whole_text_and_nothing_else(spark, fitted):
    _, _, model = fitted
    long = "abc " * 60000
    rows = [(1, "nasty rotten vilest", "en"), (1, "nasty rotten vilest", None), (None, "nasty rotten vilest", "xx"),
            (2, long + "nasty rotten vilest", "en"), (3, long, "en"), (4, None, "en"), (5, "", "de"), (6, " ,.", "de")]
    out = toxicity.score_toxicity(spark.createDataFrame([(*r, "t", 1.0) for r in rows], SCHEMA + ", text2 string, score double"), model).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(out) == len(rows) and by[1][0] == by[1][1] == by[None][0] and by[1][0] > 0.5
    assert by[2][0] > 0.5 > by[3][0] and by[4] == by[5] == by[6]
    assert {r.threshold for r in out if r.doc_id is None} == {model.threshold}


def test_drop_and_empty(spark, fitted):
    docs, lab, model = fitted
    kept = toxicity.drop_toxic(docs.withColumn("rejected", F.lit("x")), model)
    assert kept.columns == [*docs.columns, "rejected"]
    gone = toxicity.score_toxicity(docs, model).where("rejected").count()
    assert kept.count() == docs.count() - gone and gone > 0
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.score_toxicity(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "en")], SCHEMA)
    for labels, want in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {want}


def labelled(labels):
    return labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), F.xxhash64("doc_id", F.lit(42)).alias("h"))


def test_one_long_labelled_text_leaves_only_itself(spark):
    """A text of 34 MB that comes first in the order of the sample costs no other row."""
    rows, labels = corpus(900, 4)
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    first = labelled(lab).orderBy("h").first().id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.expr("repeat('nasty ', 6000000)")).otherwise(F.col("text")))
    model = toxicity.fit(long, lab)
    assert model.constant is None
    out = toxicity.score_toxicity(docs, model).join(lab, "doc_id").collect()
    assert np.mean([r.rejected == (r.toxic == 1) for r in out]) > 0.97


def test_sample_of_long_texts_keeps_every_class_and_part(spark, monkeypatch):
    rows, labels = corpus(900, 5)
    docs = spark.createDataFrame([(i, t.ljust(3000 if i % 3 else 5000, "x"), lang) for i, t, lang in rows], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sample = lambda: toxicity._sample(docs, labelled(lab), "doc_id", "text", "lang").collect()
    assert len(sample()) == 900
    count = lambda got: {k: sum((r.part, r.y) == k for r in got) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    whole = count(sample())
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 4000)
    got = sample()
    assert {r.id for r in got} == {i for i, _, _ in rows if i % 3}      # single texts only
    for size in (900_000, 300_000, 12_000):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", size)
        got = sample()
        assert sum(len(r.text) for r in got) <= max(size, 4 * 4000) and all(count(got).values())
        if size == 900_000:     # classes keep their proportions
            assert all(abs(n / len(got) - whole[k] / 900) < 0.03 for k, n in count(got).items())


def test_fit_learns_from_every_labelled_row(spark, monkeypatch):
    """Neither the limits of the sample nor the number of shards cost a row."""
    rows, labels = corpus(1200, 6)
    docs, lab = spark.createDataFrame([*rows, (7, "again", "en"), (None, "x", "en")], SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    for name, value in (("TRAIN_ROWS", 10), ("CALIBRATE_ROWS", 10), ("TEXT_BYTES", 40), ("SAMPLE_BYTES", 4000), ("SHARD_ROWS", 250)):
        monkeypatch.setattr(toxicity, name, value)
    learnt = toxicity._labelled(docs, labelled(lab), len(labels), "doc_id", "text", "lang")
    assert sorted((r.id, r.y) for r in learnt.collect()) == sorted(labels)
    assert {r.shard for r in learnt.collect()} == set(range(5))
    model = toxicity.fit(docs, lab)
    out = toxicity.score_toxicity(docs.where("doc_id <> 7"), model).join(lab, "doc_id").collect()
    assert len(out) == 1199 and np.mean([r.rejected == (r.toxic == 1) for r in out]) > 0.97


def test_thresholds_from_counts_equal_those_of_rows():
    rng = np.random.default_rng(1)
    s, y = np.round(rng.random(500), 2), (rng.random(500) < 0.3).astype(int)
    of = lambda t: 2 * y[s >= t].sum() / ((s >= t).sum() + y.sum())
    own = sorted(set(s), reverse=True)
    best = max(own, key=of)
    below = max([x for x in own if x < best], default=0.0)
    counts = pa.table({"score": own, "n": [int((s == x).sum()) for x in own], "hits": [int(y[s == x].sum()) for x in own]})
    assert toxicity._best_threshold(counts.slice(0), 0.3) == round((best + below) / 2, 6)
    assert toxicity._best_threshold(counts.slice(0, 0), 0.3) == 0.3
