"""Exact deduplication by deterministic block naming (doubling, as in suffix naming).

A normalised text is cut into blocks of ``BLOCK`` bytes.  Equal blocks get the same integer
name, different ones different names: blocks are sorted and numbered where the content
changes.  Adjacent names are then paired, the pairs named the same way, and so on until each
text has one name.  Level and name identify a text without collisions, as every name stands
for one content.

Names are given by sorting inside hash partitions, so the blocks move once.  Contents so
frequent that one of them could fill a task (more than 1/``HOT`` of all, of which there are
fewer than ``HOT``) are grouped before they move and get their names by a join instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import written

BLOCK = 4096
HOT = 256
_PART_BITS = 40


def normalised(text: Column) -> Column:
    """Each run of space, tab, LF, VT, FF and CR becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _numbered(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` (h, content, ...) with name: partition number and rank of the content in it."""
    rows = rows.repartition("h").sortWithinPartitions("h", "content")

    def run(batches):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << _PART_BITS
        last, rank = None, -1
        for batch in batches:
            content = batch.column(batch.schema.get_field_index("content"))
            if not len(content):
                continue
            new = np.ones(len(content), dtype=np.int64)
            new[0] = rank < 0 or content[0].as_py() != last
            new[1:] = pc.not_equal(content.slice(1), content.slice(0, len(content) - 1)).to_numpy(zero_copy_only=False)
            ranks = rank + np.cumsum(new)
            rank, last = int(ranks[-1]), content[len(content) - 1].as_py()
            rest = [i for i, n in enumerate(batch.schema.names) if n not in ("h", "content")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(base + ranks)],
                                             names=[*(batch.schema.names[i] for i in rest), "name"])

    return rows.mapInArrow(run, schema)


def name_contents(rows: DataFrame, level: int) -> DataFrame:
    """(key, pos, name) for rows (key, pos, content): equal names for equal contents.

    ``content`` is binary.  Names of frequent contents are negative, the others not.
    """
    rows = rows.withColumn("h", F.xxhash64("content", F.lit(level)))
    counts = rows.groupBy("h").agg(F.count("*").alias("m"))
    counts = written(counts, f"counts{level}")
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    # Fewer than HOT hashes can pass, so the list is bounded whatever the input.
    hot = [r[0] for r in counts.where(F.col("m") * HOT > total).where(F.col("m") > 1000).select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    out = _numbered(rows.where(~is_hot).select("h", "content", "key", "pos"), "key binary, pos bigint, name bigint")
    if hot:
        kinds = rows.where(is_hot).select("h", "content").distinct()
        names = written(_numbered(kinds.withColumn("c", F.col("content")), "c binary, name bigint"), f"hot{level}")
        out = out.unionByName(rows.where(is_hot).join(names, F.col("content") == F.col("c"))
                              .select("key", "pos", (-1 - F.col("name")).alias("name")))
    return written(out, f"names{level}")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space;
    a null text is empty and equals the empty text.  Of equal texts the least id stays; a null
    id stays only if no row of its group has an id.  Of rows that repeat id and text one is
    kept.  ``text_sha256`` is the digest of the normalised text in UTF-8.  An empty table gives
    an empty result.
    """
    text = F.encode(normalised(F.col(text_col)), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    # A text's rows are told apart by id and digest; rows equal in both are one key.
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary"),
                                  F.lit("|").cast("binary"), F.unhex(F.sha2("t", 256))), 256))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("t") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = (rows.select(key.alias("key"), "t", F.explode_outer(starts).alias("at"))
              .select("key", (F.col("at") / BLOCK).cast("bigint").alias("pos"),
                      F.substring("t", F.col("at") + 1, F.lit(BLOCK)).alias("content")))
    level, done = 0, None
    while True:
        names = name_contents(blocks, level)
        last = names.groupBy("key").agg(F.max("pos").alias("last"))
        names = written(names.join(written(last, "last"), "key"), "named")
        one = names.where("last = 0").select("key", F.lit(level).alias("level"), "name").distinct()
        done = one if done is None else done.unionByName(one)
        more = names.where("last > 0")
        if more.isEmpty():
            break
        left = F.when(F.col("pos") % 2 == 0, F.col("name"))
        right = F.when(F.col("pos") % 2 == 1, F.col("name"))
        # An odd end has no right neighbour; the missing name keeps such pairs apart.
        blocks = (more.groupBy("key", F.floor(F.col("pos") / 2).alias("p")).agg(F.max(left).alias("l"), F.max(right).alias("r"))
                  .select("key", F.col("p").alias("pos"),
                          F.encode(F.concat_ws(",", F.col("l").cast("string"), F.col("r").cast("string")), "UTF-8")
                          .alias("content")))
        level += 1
    ids = written(rows.select("id", key.alias("key"), F.sha2("t", 256).alias("text_sha256")), "ids")
    named = written(ids.join(done, "key"), "identity")
    group = written(named.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
                    .where("group_size > 1"), "groups")
    twice = (named.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    return _rows(named, group, twice, id_col)


def _rows(named: DataFrame, group: DataFrame, twice: DataFrame, id_col: str) -> DataFrame:
    out = named.join(group, ["level", "name"], "left")
    least = F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    out = out.select("key", "id", F.coalesce("keep_id", "id").alias("keep_id"),
                     F.coalesce("group_size", F.lit(1)).alias("group_size"), least.alias("least"), "text_sha256")
    # Rows that repeat id and text: the first stays, the others go.
    copies = out.where("least").join(written(twice, "twice"), "key", "left_semi")
    first = copies.groupBy("key").agg(F.first("id").alias("id"), F.first("keep_id").alias("keep_id"),
                                      F.first("group_size").alias("group_size"), F.count("*").alias("m"),
                                      F.first("text_sha256").alias("text_sha256"))
    again = first.select("id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"), "text_sha256")
    parts = [out.where("NOT least").select("id", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256"),
             out.where("least").join(written(twice, "twice"), "key", "left_anti")
             .select("id", "keep_id", "group_size", F.lit(True).alias("kept"), "text_sha256"),
             again.select("id", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("id", id_col)
