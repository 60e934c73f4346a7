"""Merkle manifest of a dataset, with a membership witness for every row.

A row's leaf is the digest of its fields.  The leaves of a group, in the order of their ids,
form a tree in which every run of three neighbours becomes one node; the groups' subroots
form the tree of the dataset the same way.

Witnesses grow while leaves are appended.  Aligned blocks of ``BLOCK`` leaves are appended
each in one task: an open subtree carries partial witnesses of its leaves, a sibling that
is completed later extends them, and a full run closes into its parent.  A block's root is
one more append to the tree above, in blocks again, until one node of the group is left;
the witnesses from above are then joined to the rows of a block by its number.  A tree of n
leaves takes log(n) / log(BLOCK) such rounds, and no task sees more than its blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import written

ARITY = 3
HEIGHT = 5
BLOCK = ARITY ** HEIGHT
_STEP = "array<struct<before: string, after: string>>"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Append:
    """Appends nodes to a tree and keeps the witness of every one: (before, after) for each level."""

    def __init__(self):
        self.witness: list[list[tuple[str, str]]] = []
        self._open: list[list[list]] = [[]]  # for each level: [digest, members, before, after] of its open run

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._complete(0, digest, [len(self.witness) - 1])

    def _complete(self, level: int, digest: str, members: list[int]) -> None:
        if level == len(self._open):
            self._open.append([])
        run = self._open[level]
        for sibling in run:
            sibling[3] += digest
        run.append([digest, members, "".join(s[0] for s in run), ""])
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        for _, members, before, after in run:
            for m in members:
                self.witness[m].append((before, after))
        self._complete(level + 1, _sha("".join(s[0] for s in run)), [m for s in run for m in s[1]])

    def finish(self, height: int) -> str:
        """The root, after closing what is open so that the tree has ``height`` levels of runs."""
        for level in range(height):
            if self._open[level]:
                self._close(level)
        return self._open[height][0][0]


def _height(n: int) -> int:
    """Levels of runs above the nodes of a block when its tree has ``n`` nodes on the block's level."""
    h = 0
    while h < HEIGHT and n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def leaf_digest(columns: list[Column | str]) -> Column:
    """Digest of a row: for each column its length in bytes, a colon and its value, or ``-`` for null."""
    def part(c):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def proof_digest(witness: Column | str) -> Column:
    """Digest of all siblings of a witness, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column | str, witness: Column | str) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, F.col(leaf) if isinstance(leaf, str) else leaf,
                       lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def _ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` (grp, digest, ...) with pos and n: number in the group by ``order`` and digest, and its size."""
    keys = ["grp", order, "digest", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    # The number holds the range partition and the row's place in it.
    rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
                   .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    from pyspark.sql import Window
    group = Window.partitionBy("grp")
    counts = rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), "first", F.sum("m").over(group).alias("n"),
                                   F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before")), name + "-counts")
    return (rows.join(counts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("g", "p", "at", "part", "first", "before"))


def _appended(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (grp, pos, n, digest, ...) with block, witness inside the block, and on its first row top, the block's root."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    nodes = nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")

    def witnessed(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
        digests, n = table["digest"].to_pylist(), table["n"].to_pylist()
        steps, tops = [], [None] * len(digests)
        for a, b in zip(starts, [*starts[1:], len(digests)]):
            tree = Append()
            for d in digests[a:b]:
                tree.append(d)
            tops[a] = tree.finish(_height(n[a]))
            steps += tree.witness
        flat = [s for w in steps for s in w]
        pair = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())],
                                          names=["before", "after"])
        offsets = [0]
        for w in steps:
            offsets.append(offsets[-1] + len(w))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)
        out = table.append_column("witness", lists).append_column("top", pa.array(tops, pa.string()))
        return out.combine_chunks().to_batches()[0]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            keys = list(zip(table["grp"].to_pylist(), table["block"].to_pylist()))
            starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            # The last block may go on in the next batch.
            if len(starts) > 1:
                yield witnessed(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1])
        if held is not None:
            yield witnessed(held, [0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return written(nodes.mapInArrow(run, f"{schema}, witness {_STEP}, top string"), name)


def _rounds(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all rounds of block appends, and (grp, pos, digest): the root of each group."""
    rounds, most = [], None
    while most is None or most > 1:
        done = _appended(nodes, f"{name}{len(rounds)}")
        if most is None:
            most = done.agg(F.max("n")).first()[0] or 0
        rounds.append(done)
        nodes = done.where("top IS NOT NULL").select("grp", F.col("block").alias("pos"),
                                                     F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
        most = -(-most // BLOCK)
    return rounds, nodes.select("grp", "pos", "digest")


def _joined(rounds: list[DataFrame], upper: DataFrame) -> DataFrame:
    """Rows of the first round with the whole witness and the other columns of ``upper`` (grp, pos, witness, ...)."""
    rest = [c for c in upper.columns if c not in ("grp", "pos", "witness")]
    for k, done in reversed(list(enumerate(rounds))):
        above = upper.select(F.col("grp").alias("g"), F.col("pos").alias("b"), F.col("witness").alias("above"), *rest)
        both = done.join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
        upper = both.withColumn("witness", F.concat("witness", "above")).drop("g", "b", "above", "n", "block", "top")
        if k:
            upper = written(upper.drop("digest"), "above")
    return upper


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``leaves``: id, leaf, ``keep``, subroot, root, witness.

    ``leaf_col`` holds a digest in lowercase hex (see ``leaf_digest``).  In each group the
    leaves ascend by id (null first); rows that repeat an id follow by their leaf.  While a
    group has several nodes, every three neighbours (the last run may have fewer, even one)
    become the digest of their concatenation; what remains is ``subroot``, for a group of one
    row its leaf.  Subroots, by group in the order of its bytes (null, a group of its own,
    first), likewise give ``root``.  ``witness`` lists for each level the siblings before and
    after the row's node, to the root; it is empty where the dataset has one row.

    Only digests are moved, never the rows' own columns but those in ``keep``; texts of any
    length are read where they lie.  A group of any size is spread over tasks.  An empty table
    gives an empty result.
    """
    rows = written(leaves.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"),
                                 F.col(leaf_col).alias("digest"), F.struct(F.lit(0).alias("none"), *keep).alias("kept")), "leaves")
    rounds, roots = _rounds(_ranked(rows, "id", "ranked"), "appended")
    roots = written(roots, "subroots")
    one = roots.select(F.lit("all").alias("grp"), F.col("grp").alias("group"), "digest")
    tops, last = _rounds(_ranked(one, "group", "groups"), "tops")
    none = F.array().cast(_STEP).alias("witness")
    over = (_joined(tops, last.select("grp", "pos", none, F.col("digest").alias("root")))
            .select(F.col("group").alias("g"), "witness", "root"))
    upper = written(roots.join(over, F.col("grp").eqNullSafe(F.col("g")))
                    .select("grp", "pos", "witness", F.col("digest").alias("subroot"), "root"), "above")
    out = _joined(rounds, upper)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"),
                      *[F.col("kept").getField(c).alias(c) for c in keep], "subroot", "root", "witness")
