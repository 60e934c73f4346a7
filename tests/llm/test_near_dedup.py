import random
import re

import numpy as np
import pyarrow as pa
import pytest

from odflow.llm import _sketch, _words, near_dedup
from odflow.llm.components import components
from odflow.llm.near_dedup import drop_near_duplicates, near_duplicates


def shingle_set(text, width):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width=4, percent=80):
    sets = {i: shingle_set(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def answer(df):
    return {r[0]: (r[1], r[2], r[3]) for r in df.collect()}


def test_words_and_shingles_as_in_python():
    texts = ["", None, "One", "a b\tc\x0bd\x0ce", "É é  x y z", "w " * 9, "A" * 50, "  lead trail \n"]
    words, first = _words.word_hashes(*_words.buffers(pa.array(texts, pa.string())))
    for width in (1, 4, 5):
        sh, at = _words.shingles(words, first, width)
        for i, t in enumerate(texts):
            assert len(np.unique(sh[at[i]:at[i + 1]])) == len(shingle_set(t, width))


def test_pieces_do_not_change_words(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += ["x" * 9000 + " y", "z" * 5000]
    whole = _words.word_hashes(*_words.buffers(pa.array(texts)))
    monkeypatch.setattr(_words, "PIECE", 64)
    cut = _words.word_hashes(*_words.buffers(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@pytest.mark.parametrize("size", [1, 2, 7, 60, 5000])
def test_sketch_fills_every_bin_and_estimates_similarity(size):
    rng = np.random.default_rng(size)
    a = rng.integers(0, 2**63, size).astype(np.uint64)
    b = a.copy()
    b[: size // 5] = rng.integers(0, 2**63, size // 5).astype(np.uint64)
    sh, at = _sketch.distinct(np.concatenate([a, b]), np.array([0, size, 2 * size]))
    table = _sketch.sketch(sh, at, 240)
    assert (table != np.iinfo(np.uint64).max).all()
    j = _sketch.overlap(np.unique(a), np.unique(b)) / len(np.union1d(a, b))
    assert abs((table[0] == table[1]).mean() - j) < 5 * (0.25 / 240) ** 0.5


def test_edge_cases(docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two  three"),
            (8, "a b c d"), (9, "a b c d a b c d"), (None, "one"), (10, "x " * 30000), (11, "x " * 29000)]
    out = near_duplicates(docs(rows), width=4)
    got = answer(out)
    want = brute([r for r in rows if r[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (1, None, True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(docs([])).count() == 0


def test_against_brute_force_with_families(docs):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 14)):
            t = base[:]
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rng.shuffle(rows)
    assert answer(near_duplicates(docs(rows), width=4)) == brute(rows)


def test_family_split_over_chunks(docs, monkeypatch):
    from odflow.llm import near_dedup
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    monkeypatch.setattr(near_dedup, "MORE", 5)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        t = base[:]
        for _ in range(i // 10):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    assert answer(near_duplicates(docs(rows), width=4)) == brute(rows)


def test_repeated_rows_and_pipeline_form(docs):
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(3, text), (3, text), (5, text), (9, None), (9, None), (None, text)]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs(rows)).collect())
    assert [g[1:] for g in got if not g[0]] == [(3, 3, True), (3, 3, True), (5, 3, False), (9, 9, True), (9, 9, True)]
    left = drop_near_duplicates(docs(rows))
    assert left.columns == docs(rows).columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [3, 9, 9]
    assert left.where("doc_id IS NULL").count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (30, 25), (200, 150)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n + 1, n + 40)]
        up = {}

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for a, b in links:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        df = spark.createDataFrame([*links, (None, 1)], "u bigint, v bigint")
        got = dict(components(df).collect())
        want = {x: top(x) for e in links for x in e if top(x) != x}
        assert got == want


def template_pages(n, seed=4):
    """Pages of one template: about 0.7 similar, none linked."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(330)]
    return [(i, " ".join(base + [word() for _ in range(55)])) for i in range(n)]


def folder_bytes(path):
    import os
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_template_pages_move_in_proportion(spark, docs, tmp_path, monkeypatch):
    from odflow.llm import near_dedup
    seen = {}
    for n in (500, 2000):
        kept = []

        def counted(df, name, rows=None, into=kept, k=n):
            path = str(tmp_path / f"{k}-{len(into)}")
            df.write.parquet(path)
            into.append(path)
            return spark.read.schema(df.schema).parquet(path)

        monkeypatch.setattr(near_dedup, "written", counted)
        rows = template_pages(n)
        out = near_dedup.near_duplicates(docs(rows))
        assert out.where("kept").count() == n
        seen[n] = sum(folder_bytes(p) for p in kept), sum(len(t) for _, t in rows)
    assert seen[2000][0] < 3 * seen[2000][1] and seen[2000][0] < 7 * seen[500][0], seen


def test_links_outside_the_centres(docs, monkeypatch):
    """Variants whose links form chains and side groups that no centre reaches."""
    from odflow.llm import near_dedup
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    monkeypatch.setattr(near_dedup, "MORE", 2)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = []
    for side in range(6):
        t = base[:]
        for k in range(side * 12):
            t[(k * 17) % 200] = word()
        for _ in range(8):
            u = t[:]
            for _ in range(rng.randint(0, 4)):
                u[rng.randrange(200)] = word()
            rows.append((len(rows), " ".join(u)))
    rng.shuffle(rows)
    assert answer(near_duplicates(docs(rows), width=4)) == brute(rows)


def test_text_ids_are_rejected_and_names_may_clash(spark):
    df = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id must be an integer"):
        near_duplicates(df)
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, text, "p", 1, "x"), (2, text, "q", 2, "y"), (None, text, "r", 3, "z"), (None, "other words entirely", "s", 4, "w"),
            (None, "other words entirely", "t", 5, "v")]
    clash = spark.createDataFrame(rows, "doc_id int, text string, __key string, __gone int, kept string")
    left = drop_near_duplicates(clash)
    assert left.columns == clash.columns
    assert sorted((r[0] is None, r[3]) for r in left.collect())[0] == (False, 1)
    assert left.count() == 2


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, gone in ((1, 0), (60, 7), (800, 100), (9000, 2000)):
        own = np.unique(rng.integers(0, 1 << 63, n + gone, dtype=np.uint64))
        other = np.unique(np.concatenate([own[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
        x, y = (np.array(near_dedup._parity(s)).view(np.uint8) for s in (own, other))
        differ = int(np.unpackbits(x ^ y).sum())
        assert differ <= len(np.setxor1d(own, other))
        assert gone or not differ


def test_edited_texts_around_the_limit_against_brute_force(spark, monkeypatch):
    """A family of edited texts whose similarities lie on both sides of the limit, with few centres."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 5))):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(146)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    met, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    monkeypatch.setattr(near_dedup, "MORE", 4)
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *a: (met.append(pairs.count()), confirmed(pairs, *a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root))
    assert sum(met) < len(texts) ** 2 // 8
