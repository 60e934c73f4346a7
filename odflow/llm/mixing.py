"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source with the target weight w (weights are scaled to sum 1) and n of all N documents is
to be repeated w * N / n times on average.  Each document draws its count from the Poisson
distribution of that mean by inverting it at a hash of (seed, id): the same document gets
the same count on any cluster and in any order, and the expected size of each source is
exactly its weight.  Copies are then put in the order of another hash of (seed, id, copy).

A mean above ``PIECE`` is split into equal parts that are drawn independently and summed,
which is the same distribution and never underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import free_name, written

PIECE = 8.0
# P(Poisson(8) > 64) is below 2**-52, the spacing of the hashed uniform numbers.
MOST = 64


def hashed_bits(*parts: Column | str) -> Column:
    """The first 52 bits of the SHA-256 of the parts joined by ``|``, as a bigint."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def hashed_uniform(*parts: Column | str) -> Column:
    """``hashed_bits`` as a number in [0, 1)."""
    return hashed_bits(*parts) / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, documents, rate.  ``weights`` names the sources' target weights; a source it
    does not name gets none.  Without it a source weighs the square root of its number of
    documents, which lifts small sources against a dominant one."""
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("documents"))
    if weights is None:
        weight = F.sqrt(F.col("documents").cast("double"))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    per = written(per.withColumn("weight", weight), "sources")
    total = per.agg(F.sum("documents").alias("all_documents"),
                    F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("all_weight"))
    share = F.coalesce(F.try_divide(F.col("weight"), F.col("all_weight")), F.lit(0.0))
    return (per.crossJoin(F.broadcast(total))  # one row
            .select("source", "documents", (share * F.col("all_documents") / F.col("documents")).alias("rate")))


def poisson_count(rate: Column, *key: Column | str) -> Column:
    """The Poisson count of mean ``rate`` at the hash of ``key``."""
    pieces = F.ceil(rate / PIECE).cast("int")
    mean = rate / pieces
    uniform = F.transform(F.sequence(F.lit(1), pieces), lambda i: hashed_uniform(*key, i.cast("string")))

    def draw(u: Column) -> Column:
        """The least k whose cumulative probability exceeds u, term by term."""
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(MOST)), start,
            lambda a, k: F.when(u < a["c"], a).otherwise(
                F.struct(k.alias("k"), (a["p"] * mean / k).alias("p"),
                         (a["c"] + a["p"] * mean / k).alias("c"))))["k"]

    return F.when(rate > 0, F.aggregate(uniform, F.lit(0), lambda n, u: n + draw(u))).otherwise(F.lit(0))


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix",
                weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` with __copies, the number of times each row is to be taken (0 drops it).

    Null sources are a source of their own.  A null id hashes as an empty text; rows that
    repeat an id get the same count.  An empty table stays empty.
    """
    return _counted(docs, id_col, source_col, seed, weights, free_name(docs, "__copies"))


def _counted(docs, id_col, source_col, seed, weights, copies: str) -> DataFrame:
    source, rate = free_name(docs, "__source"), free_name(docs, "__rate")
    per = rates(docs, source_col, weights).select(F.col("source").alias(source), F.col("rate").alias(rate))
    per = written(per, "rates")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (docs.join(per, F.col(source_col).eqNullSafe(F.col(source)))
            .select(*[docs[c] for c in docs.columns], poisson_count(F.col(rate), seed, key).alias(copies)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix",
        weights: dict[str | None, float] | None = None, copy_col: str = "__copy", order_col: str = "__order") -> DataFrame:
    """The mixed corpus: ``docs``' columns, __copy (from 0) and __order, sorted by __order.

    __order is a 52-bit hash of (seed, id, copy); rows come in its order over
    the whole result, by a range partitioning, so copies of one document lie far apart.  Rows
    that tie in it (those that repeat an id) come in any order.  Null sources are a source of
    their own, a null id hashes as an empty text, null, empty and very long texts are passed
    through.  ``copy_col`` and ``order_col`` are lengthened by ``_`` where a column of ``docs``
    has the name.  An empty table stays empty.
    """
    copies, copy, order = free_name(docs, "__copies"), free_name(docs, copy_col), free_name(docs, order_col)
    chosen = _counted(docs, id_col, source_col, seed, weights, copies).where(F.col(copies) > 0)
    each = chosen.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy))
    place = hashed_bits(seed, "order", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy).cast("string"))
    return each.withColumn(order, place).orderBy(order)
