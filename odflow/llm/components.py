"""Connected components of a link table by alternating star contraction.

Each round replaces every link by links to the least neighbour (large star: greater
neighbours move to the least one; small star: smaller neighbours move too) until only
stars are left.  Links stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import written


#: Links that one task may hold; below it a round needs no shuffle at all.
TASK_LINKS = 250_000


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the least node reachable, for every node of ``links`` but the roots.

    ``links`` has two bigint columns; order, repeats, self-links and nulls do not matter.
    """
    edges = written(links.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
                    .where("a > b").distinct(), "links", TASK_LINKS)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Links of a hot node are split by AQE: the other side is a plain table with one row a node.
        least = written(_least(both).select("n", F.least("n", "m").alias("m")), "least", TASK_LINKS)
        large = written(both.where("b > a").join(least, F.col("a") == F.col("n"))
                        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(),
                        "large", TASK_LINKS)
        least = written(_least(large), "least", TASK_LINKS)
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        edges = written(large.join(least, F.col("a") == F.col("n"))
                        .select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.*")
                        .where("a > b").distinct(), "links", TASK_LINKS)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a root that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
                        .alias("e")).select("e.*")
    return (ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where("up > 1 OR (up > 0 AND down > 0)").isEmpty())
