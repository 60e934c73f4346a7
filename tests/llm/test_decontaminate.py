import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from odflow.llm import decontaminate as d


def words(t):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]


def brute_scores(items, text):
    """BM25 share of each item in each passage, straight from the formula."""
    segs = []
    for i, t in items:
        w = words(t)
        segs += [(i, w[s:s + d.SEGMENT]) for s in range(0, len(w), d.SEGMENT)]
    mean = sum(len(s) for _, s in segs) / len(segs)
    df = {}
    for _, s in segs:
        for w in set(s):
            df[w] = df.get(w, 0) + 1

    def weight(w, s):
        tf = s.count(w)
        idf = math.log1p((len(segs) - df[w] + 0.5) / (df[w] + 0.5))
        return idf * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(s) / mean))

    cell = max(32, max(len(s) for _, s in segs))
    t = words(text)
    cells = [set(t[k:k + cell]) for k in range(0, len(t), cell)]
    passages = [a | b for a, b in zip(cells, cells[1:])] or cells
    best = {}
    for p in passages:
        for i, s in segs:
            x = sum(weight(w, s) for w in set(s) & p) / sum(weight(w, s) for w in set(s))
            best[i] = max(best.get(i, 0), x)
    return best


def corpus(seed, n_items=40, n_docs=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubcd") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    sent = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    items = [(i, "\n".join(sent(rng.randint(4, 30)) for _ in range(rng.randint(1, 3)))) for i in range(n_items)]
    items.append((n_items, sent(300)))
    docs, want = [], set()
    for k in range(n_docs):
        body = sent(rng.randint(0, 400))
        if k % 3 == 0:
            i, t = items[rng.randrange(len(items))]
            body = sent(rng.randint(0, 90)) + " " + t + "\n" + body
            want.add((k, i))
        docs.append((k, body))
    return items, docs, want


def test_retrieval_is_exact():
    items, docs, _ = corpus(1)
    index = d.Index([(i, t.lower()) for i, t in items])
    words_, first = d._hash_texts([t.lower() for _, t in docs])
    for threshold in (0.15, 0.4):
        text, seg, score = index.retrieve(words_, first, threshold)
        got = {}
        for t, s, x in zip(text, seg, score):
            key = (int(t), index.ids[index.owner[s]])
            got[key] = max(got.get(key, 0), x)
        want = {(k, i): x for k, (_, t) in enumerate(docs) for i, x in brute_scores(items, t).items() if x >= threshold}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_leaks_found_and_clean_documents_left(spark, docs):
    items, rows, want = corpus(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(docs(rows), bench).collect()}
    assert found >= want
    for k, i in found - want:      # any other hit must hold at least half of the item word for word
        t, s = words(rows[k][1]), words(dict(items)[i])
        have = {tuple(t[j:j + 5]) for j in range(len(t) - 4)}
        assert sum(tuple(s[j:j + 5]) in have for j in range(len(s) - 4)) >= (len(s) - 4) / 2
    left = d.decontaminate(docs(rows), bench)
    assert left.columns == docs(rows).columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in rows} - {k for k, _ in found}


def test_benchmark_in_blocks_gives_the_same(spark, docs, monkeypatch):
    items, rows, want = corpus(3)
    monkeypatch.setattr(d, "ITEMS", 9)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs(rows), bench).collect()} >= want


def test_scores_do_not_depend_on_the_blocks(spark, docs, monkeypatch):
    items, rows, _ = corpus(3)
    rows += [(100 + i, " ".join(t.split()[:max(1, 2 * len(t.split()) // 3)])) for i, t in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: sorted(tuple(r) for r in d.find_leaks(docs(rows), bench).collect())
    whole = found()
    monkeypatch.setattr(d, "ITEMS", 9)
    blocks = found()
    assert [r[:2] for r in blocks] == [r[:2] for r in whole]
    assert np.allclose(np.array(blocks, float), np.array(whole, float), atol=2e-6) and any(r[2] < 0.99 for r in whole)


def test_items_without_id_are_filtered(spark, docs):
    item = "what is the largest planet of our solar system.\nthe largest planet is jupiter with many moons"
    bench = spark.createDataFrame([(None, item), (2, "an other item of some words.")], "item_id bigint, text string")
    rows = [(1, "so " + item), (2, "clean text"), (None, "an other item of some words")]
    assert [r.doc_id for r in d.decontaminate(docs(rows), bench).collect()] == [2]


def test_question_or_answer_alone(spark, docs):
    """Every side of 13 words or more is found alone, however little its item's segment it weighs."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioubcd") for _ in range(rng.randint(3, 6))) for _ in range(900)]
    sent = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    sizes = [(115, 13), (13, 115), (14, 300), (300, 14), (60, 20), (200, 13), (12, 60), (60, 12), (13, 13), (150, 150)]
    items = [(i, sent(q) + "\n" + sent(a)) for i, (q, a) in enumerate(sizes)]
    rows = []
    for _, t in items:
        q, a = d.question_and_answer(t)
        rows += [q, a, sent(300) + " " + q + " " + sent(700), sent(500) + " " + a + " " + sent(90)]
        w = a.split()
        # A side in pieces far apart still holds its word runs; one word changed leaves a part.
        rows += [" ".join(w[:len(w) // 2 + 4]) + " " + sent(900) + " " + " ".join(w[len(w) // 2:]),
                 " ".join(w[:-1]) + " zzz", " ".join([*w[:6], "zzz", *w[7:]])]
    rows = list(enumerate(rows))
    runs = lambda w: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}
    want = set()
    for k, t in rows:
        have = runs(words(t))
        for i, item in items:
            for side in d.question_and_answer(item):
                s = runs(words(side))
                if len(words(side)) >= d.SIDE_WORDS and len(s & have) / len(s) >= d.SIDE:
                    want.add((k, i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in d.find_leaks(docs(rows), bench).collect()}
    assert len(want) > 50 and set(found) >= want
    assert all(max(r.question_overlap, r.answer_overlap) >= d.SIDE or r.overlap >= d.OVERLAP for r in found.values())
    verbatim = [(7 * i + j, i) for i, (q, a) in enumerate(sizes) for j, n in ((0, q), (1, a), (2, q), (3, a)) if n >= d.SIDE_WORDS]
    assert all(found[k].score == 1 for k in verbatim)
    left = {r.doc_id for r in d.decontaminate(docs(rows), bench).collect()}
    assert left == {k for k, _ in rows} - {k for k, _ in found}


def test_edge_cases(spark, docs):
    item = "what is the largest planet of our solar system.\nthe largest planet is jupiter with many moons"
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, ""), (4, "...")], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (3, "   "), (4, item), (4, item), (None, item.upper()), (5, "no " * 40000),
            (6, "no " * 40000 + item.replace(" ", " - "))]
    got = sorted(((r.doc_id, r.item_id) for r in d.find_leaks(docs(rows), bench).collect()), key=repr)
    assert got == sorted([(4, 1), (4, 1), (6, 1), (None, 1)], key=repr)
    assert d.find_leaks(docs([]), bench).count() == 0
    assert d.find_leaks(docs(rows), bench.where("false")).count() == 0
    assert d.decontaminate(docs(rows), bench.where("false")).count() == len(rows)


def test_question_and_answer():
    assert d.question_and_answer("a b?\nc d") == ("a b?", "c d")
    assert d.question_and_answer("one two. three four.") == ("one two.", "three four")
    assert d.question_and_answer("only one") == ("only one", "")


def test_index_size_at_its_bound():
    import pickle
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40_000)]
    common = vocab[:300]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(rng.randint(100, 400))))
             for i in range(2000)]
    index = d.Index(items)
    assert sum(len(t) for _, t in items) > 2_500_000
    assert len(pickle.dumps(index)) < 50_000_000


def test_names_may_clash_and_text_item_ids_are_rejected(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron")], "item_id int, text string")
    leak = "so alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron it is"
    docs = spark.createDataFrame([(1, leak, "a", 1), (2, "clean words", "b", 2)], "doc_id int, text string, __text string, __Text_ int")
    left = d.decontaminate(docs, bench)
    assert left.columns == docs.columns and [r[0] for r in left.collect()] == [2]
    with pytest.raises(TypeError, match="item_id must be an integer"):
        d.find_leaks(docs, bench.selectExpr("cast(item_id AS string) item_id", "text"))
