"""The corpus pipeline: five stages from raw documents to shards.

toxicity -> near duplicates -> benchmark decontamination -> mixing -> sharding.  Each stage
takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``.  The last returns the shard
manifest: a row per document with its shard and its slot there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from odflow.llm import toxicity
from odflow.llm._store import written
from odflow.llm.decontaminate import decontaminate
from odflow.llm.mixing import mix
from odflow.llm.near_dedup import drop_near_duplicates
from odflow.llm.queries import held_out
from odflow.llm.sharding import shard_documents

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold (labels not held out teach it)."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.drop_toxic(docs, model)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's weight, in a global hashed order."""
    return mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard manifest: 16 shards of near equal bytes, each in the order of the mix."""
    return shard_documents(docs, SHARDS, order_seed="mix")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near), ("decontaminate", drop_leaks),
          ("mixing", mix_sources), ("sharding", shard)]

#: A trained network takes part, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
