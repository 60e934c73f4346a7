import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from odflow.llm import _words, decontaminate, near_dedup, periodic_runs, toxicity


def hashed(text="a few words, hashed on the driver"):
    return _words.word_hashes(*_words.buffers(pa.array([text])))


@pytest.mark.parametrize("code", [_words.word_hashes, near_dedup._sets, periodic_runs._tokens, decontaminate.Index.hits, toxicity.buckets],
                         ids=lambda f: f.__qualname__)
def test_task_code_leaves_the_drivers_powers_behind(code):
    hashed()
    assert len(cloudpickle.dumps(code)) < 1 << 18


def test_shipped_code_hashes_alike():
    want, first = hashed()
    there = cloudpickle.loads(cloudpickle.dumps(_words.word_hashes))
    got, at = there(*_words.buffers(pa.array(["a few words, hashed on the driver"])))
    assert np.array_equal(got, want) and np.array_equal(at, first)


def files(spark):
    folder = spark.sparkContext._temp_dir
    return {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}


def test_fit_leaves_no_broadcast_on_the_drivers_disk(spark):
    hashed()
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat_ws(
        " ", F.lit("plain words"), F.when(F.col("id") % 3 == 0, "nasty"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    before = files(spark)
    model = toxicity.fit(docs, labels)
    assert model.constant is None and set(files(spark)) <= set(before)


def test_decontaminate_leaves_its_index_alone(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "what is it that a benchmark asks? an answer")], "item_id bigint, text string")
    before = files(spark)
    assert decontaminate.decontaminate(docs, bench).count() == 2
    assert sum(n for name, n in files(spark).items() if name not in before) < 4 << 20
