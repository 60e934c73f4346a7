import zlib

import duckdb
import pytest

import corpus_pipeline
import __spark_entry__ as entry
from odflow.llm import toxicity
from odflow.llm.queries import ORACLE, QUERIES, held_out

SF = "/root/testdata/sf0.001"


def test_registry():
    q = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) | {"pipeline"} <= set(q)
    assert all((f.__doc__ or "").strip() for f in QUERIES.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF)))
        docs = out[-1][1]
        docs = docs.checkpoint()
        out[-1] = (out[-1][0], docs)
    return out


def test_stages_keep_the_columns(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(d.columns == names for _, d in stages[:-1])


def test_toxic_stage(spark, stages):
    before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    keep = {r[0] for r in toxicity.score_toxicity(before, model).where("NOT rejected").collect()}
    assert {r.doc_id for r in after.collect()} == keep


def test_near_stage_against_brute_force(stages):
    from tests.llm.test_near_dedup import brute
    before, after = stages[1]
    want = brute([(r.doc_id, r.text) for r in before.collect()], width=5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, w in want.items() if w[2])


def test_leak_stage_against_word_runs(spark, stages):
    from tests.llm.test_decontaminate import words
    before, after = stages[2]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        t = words(r.text)
        have = {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
        share = max(sum(tuple(s[i:i + 5]) in have for i in range(len(s) - 4)) / (len(s) - 4) for s in items)
        assert (r.doc_id in kept) == (share < 0.5)


def test_mixing_and_sharding_stages(stages):
    from tests.llm.test_native import poisson
    before, after = stages[3]
    rows = before.collect()
    n = {}
    for r in rows:
        n[r.source] = n.get(r.source, 0) + 1
    total = sum(v ** 0.5 for v in n.values())
    want = sorted(r.doc_id for r in rows for _ in range(
        poisson(n[r.source] ** 0.5 / total * len(rows) / n[r.source], "mix", str(r.doc_id))))
    mixed = after.collect()
    assert sorted(r.doc_id for r in mixed) == want
    manifest = stages[4][1].collect()
    assert sorted((r.doc_id, r.text_crc32) for r in manifest) == sorted(
        (r.doc_id, zlib.crc32((r.text or "").encode())) for r in mixed)
