import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from odflow.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels of a tree over ``nodes``, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def witness(levels, pos):
    out = []
    for level in levels[:-1]:
        a = pos - pos % 3
        out.append(("".join(level[a:pos]), "".join(level[pos + 1:a + 3])))
        pos //= 3
    return out


def brute(leaves):
    """{(source, id, leaf): [(subroot, root, witness)]} from (id, source, leaf)."""
    groups = {}
    for i, s, leaf in leaves:
        groups.setdefault(s, []).append((i is not None, i if i is not None else 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for *_, leaf in sorted(groups[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = {}
    for k, s in enumerate(names):
        for pos, (known, i, leaf) in enumerate(sorted(groups[s])):
            out.setdefault((s, i if known else None, leaf), []).append(
                (trees[s][-1][0], top[-1][0], witness(trees[s], pos) + witness(top, k)))
    return {k: sorted(v) for k, v in out.items()}


SIZES = {None: 5, "": 1, "a": 1, "b": 2, "c": 3, "d": 4, "é": 9, "z": 10, "e": 242, "f": 243, "g": 244, "h": 729, "i": 1500}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    ids = list(range(sum(SIZES.values())))
    rng.shuffle(ids)
    return [(ids.pop(), s, "en" if rng.random() < 0.5 else None, rng.choice([None, 7]),
             rng.choice([None, "", "a\nb", "äö\n", "plain", f"t{rng.random()}"])) for s, n in SIZES.items() for _ in range(n)]


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def test_manifest_equals_trees_built_at_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = merkle.manifest(df.withColumn("leaf", merkle.leaf_digest(["doc_id", "source", "lang", "n_chars", "text"])), keep=("lang", "source"))
    want = brute([(r[0], r[1], leaf_of(r)) for r in rows])
    langs = {r[0]: r[2] for r in rows}
    got = out.select("*", merkle.proof_digest("witness").alias("proof"), merkle.fold("leaf", "witness").alias("again")).collect()
    assert len(got) == len(rows)
    for r in got:
        steps = [tuple(s) for s in r["witness"]]
        assert [(r["subroot"], r["root"], steps)] == want[r["source"], r["doc_id"], r["leaf"]]
        assert r["lang"] == langs[r["doc_id"]]
        assert r["proof"] == sha("".join(a + b for a, b in steps)) and r["again"] == r["root"]


def test_append_is_incremental():
    nodes = [sha(str(i)) for i in range(243)]
    for n in (1, 2, 3, 4, 8, 9, 10, 27, 80, 82, 242, 243):
        adder = merkle.Append()
        for d in nodes[:n]:
            adder.append(d)
        levels = tree(nodes[:n])
        assert adder.finish(merkle._height(n)) == levels[-1][0]
        assert adder.witness == [witness(levels, i) for i in range(n)]


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, "n"), (None, "s", "x"), (1, "s", "y"), (1, "s", "y"), (1, "s", "a"), (1, "t", "y")]
    leaves = [(i, s, sha(t)) for i, s, t in rows]
    out = merkle.manifest(spark.createDataFrame(leaves, "doc_id bigint, source string, leaf string"), keep=("source",)).collect()
    got = {}
    for r in out:
        got.setdefault((r["source"], r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], [tuple(s) for s in r["witness"]]))
    assert {k: sorted(v) for k, v in got.items()} == brute(leaves)


def test_one_row_empty_table_and_clashing_names(spark):
    schema = "digest string, grp string, pos string, n int, kept string, witness string"
    df = spark.createDataFrame([("id1", "g", sha("x"), 3, "k", "w")], schema)
    r = merkle.manifest(df, "digest", "grp", "pos", keep=("n", "kept")).first()
    assert (r["leaf"], r["subroot"], r["root"], r["witness"], r["n"], r["kept"]) == (sha("x"), sha("x"), sha("x"), [], 3, "k")
    assert merkle.manifest(df.limit(0), "digest", "grp", "pos").count() == 0


def test_leaf_of_long_text(spark):
    text = "ü" * 2_000_000
    got = spark.createDataFrame([(1, text)], "a int, b string").select(merkle.leaf_digest(["a", "b"])).first()[0]
    assert got == sha(f"1:1{len(text) * 2}:4000000".replace(f"{len(text) * 2}:4000000", f"4000000:{text}"))


def test_query_equals_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([(r[0], r[1], leaf_of(r)) for r in rows])
    by_id = {r[0]: r for r in rows}
    got = queries.op12(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    changed = 0
    for r in got:
        row = by_id[r["doc_id"]]
        leaf = leaf_of(row)
        subroot, root, steps = want[row[1], row[0], leaf][0]
        h = leaf
        if zlib.crc32(str(row[0]).encode()) % 2 == 0:
            h = leaf_of((*row[:4], row[4] and row[4].replace("\n", "")))
        changed += h != leaf
        for a, b in steps:
            h = sha(a + h + b)
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == sha("".join(a + b for a, b in steps))
        assert (r["folded_root"], r["verified"]) == (h, h == root)
    assert changed > 100 and sum(not r["verified"] for r in got) == changed
    assert spark.createDataFrame(got).select(F.countDistinct("root")).first()[0] == 1
