"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a list of k part sizes.  Differencing repeatedly takes the two with
the largest spread (largest minus smallest part) and joins them oppositely ordered, the
largest part of one with the smallest of the other, until one is left.

One heap over all groups of a large corpus would sit in one task.  So, while more than
``TOP`` items are left, items are dealt by hash into chunks of about ``CHUNK``, and each
chunk is differenced into ``BUNDLES`` parts, which are the items of the next level; the
last level differences the remaining items into the shards.  Items above a fraction of a
shard, of which there can only be a bounded number, skip the chunks; so does a hashed share
of all items, which keeps fine sizes for the last level to even out bundles with.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import written
from odflow.llm.mixing import hashed_bits

CHUNK, BUNDLES, TOP = 16384, 64, 24576
#: Items above 1/LARGE of all bytes go straight to the last level; there are fewer than LARGE.
LARGE = 4096
#: About so many items of each level are kept whole for the last one.
FINE = 4096
SLOT_ROWS = 20000


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k - 1) of each item, by k-way differencing; O(n (log n + k))."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # A node is a partial partition: its parts descend; where[i] says in which part of its
    # parent its i-th part ends up.
    left, right = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1)
    where = [None] * (2 * n - 1)
    heap = []
    for i in range(n):
        parts = np.zeros(k, dtype=np.int64)
        parts[0] = sizes[i]
        heap.append((-int(sizes[i]), i, parts))
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(-total, kind="stable")
        place = np.empty(k, dtype=np.int64)
        place[order] = np.arange(k)
        left[node], right[node] = a, b
        where[a], where[b] = place, place[::-1]
        total = total[order]
        heapq.heappush(heap, (int(total[-1] - total[0]), node, total))
    parts = np.zeros(n, dtype=np.int64)
    final = {2 * n - 2: np.arange(k)}
    for node in range(2 * n - 2, n - 1, -1):
        down = final.pop(node)
        for child in (left[node], right[node]):
            final[child] = down[where[child]]
    for i in range(n):
        parts[i] = final[i][0]
    return parts


def _differenced(items: DataFrame, chunk, k: int, name: str) -> DataFrame:
    """item, chunk, part: each chunk of (item, size) rows differenced into k parts."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("item", "ascending")])
        part = difference(table["size"].to_numpy(), k)
        return pa.table({"item": table["item"], "size": table["size"], "chunk": table["chunk"],
                         "part": pa.array(part)})

    return written(items.select("item", "size", chunk.cast("bigint").alias("chunk")).groupBy("chunk")
                   .applyInArrow(run, "item string, size bigint, chunk bigint, part bigint"), name)


def balanced(items: DataFrame, shards: int) -> DataFrame:
    """item, shard for a table of (item string, size bigint) with distinct items."""
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0))).first()
    level, passed, maps = items, None, []
    step = 0
    while n > TOP:
        step += 1
        key = F.xxhash64("item", F.lit(step))
        direct = ((F.col("size") * LARGE > F.lit(total)) |
                  (F.pmod(key, F.lit(1 << 20)) < F.lit(max(1, (FINE << 20) // n))))
        keep = level.where(direct)
        passed = keep if passed is None else passed.unionByName(keep)
        chunks = -(-n // CHUNK)
        cut = _differenced(level.where(~direct),
                           F.pmod(F.xxhash64("item", F.lit(-step)), F.lit(chunks)), BUNDLES, "bundles")
        bundle = F.concat_ws("/", F.lit(f"bundle{step}"), F.col("chunk"), F.col("part"))
        maps.append(cut.select(bundle.alias("bundle"), "item"))
        level = cut.groupBy(bundle.alias("item")).agg(F.sum("size").alias("size"))
        level = written(level, "items")
        n = level.count()
    top = level if passed is None else level.unionByName(passed)
    placed = _differenced(top, F.lit(0), shards, "shards").select("item", F.col("part").cast("int").alias("shard"))
    for cut in reversed(maps):
        inner = cut.join(placed.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
        placed = placed.where(~F.startswith("item", F.lit(f"bundle{len(maps)}/"))).unionByName(inner)
        maps = maps[:-1]
    return written(placed, "placed")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                    text_col: str = "text", order_seed: str | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1.  Equal texts are one indivisible group; a null
    text counts as empty, so null and empty texts are one group.  The law is ``bytes``: the
    shards' total sizes are as near equal as differencing makes them.  ``slot`` numbers a
    shard's documents from 0 without gaps, in an order fixed by id and text; rows that repeat
    id and text take neighbouring slots, a null id comes first of its block.  With ``order_seed``
    a shard's slots follow the order that ``mixing.mix`` gives under that seed, a hash of (seed,
    id, copy), rows that repeat id and text being the copies.  ``grown_shard``
    is null: under this law one more shard moves documents freely.  An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                               F.crc32(text).alias("crc"), F.sha2(text, 256).alias("item")), "rows")
    groups = written(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("copies")), "groups")
    placed = balanced(groups.select("item", "size"), shards)
    out = rows.join(placed, "item")
    # Slots: rows are dealt by hash into blocks of bounded size, numbered inside a block, and
    # moved up by the rows of the shard's blocks before it.
    blocks = -(-max(1, rows.count()) // SLOT_ROWS)
    block, order = F.pmod(F.xxhash64("id", "item", F.lit(3)), F.lit(blocks)), "id, item"
    if order_seed is not None:
        out = (out.withColumn("copy", F.expr("row_number() OVER (PARTITION BY id, item ORDER BY crc) - 1"))
               .withColumn("place", hashed_bits(order_seed, "order", F.coalesce(F.col("id").cast("string"), F.lit("")),
                                                F.col("copy").cast("string"))))
        block, order = F.floor(F.col("place") / F.lit(float(1 << 52)) * blocks), "place, id, item"
    out = written(out.withColumn("block", block), "blocks")
    sizes = out.groupBy("shard", "block").agg(F.count("*").alias("m"))
    before = sizes.select("shard", "block", F.expr(
        "sum(m) OVER (PARTITION BY shard ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        .alias("offset"))
    return (out.join(written(before, "offsets"), ["shard", "block"])
            .withColumn("i", F.expr(f"row_number() OVER (PARTITION BY shard, block ORDER BY {order}) - 1"))
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                    "shard", (F.coalesce("offset", F.lit(0)) + F.col("i")).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
