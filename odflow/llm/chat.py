"""Chat formatting: minimum-cost role repair, then rendering.

Legal conversations are those of a small automaton over the roles: an optional system turn
first, then user and assistant in turn, ending with the assistant.  Each turn of the input
is kept, relabelled, or merged into the turn before it (of the same role, after relabelling
if need be), and empty turns may be inserted where the automaton asks for one.  Dynamic
programming finds the cheapest repair, and among these the one with fewest turns.

A conversation of any length is spread out: rows are range-partitioned by conversation and
turn, and a conversation that spans partitions is solved from one 4 x 4 table of costs per
partition (role before, role after), which are chained on the driver: at most two small
tables for each partition, whatever the length.  Only roles enter the tables, not texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import shared_dir

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("",) + ROLES
MERGE, INSERT, RELABEL = 1, 2, 3
_COST = 1 << 32          # a weight is cost * _COST + turns put out
_INF = np.int64(1) << 61

#: What has to be inserted for one role to follow another; missing pairs are illegal.
GAP: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: What closes a conversation after its last role.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _moves(role: int) -> list[tuple[int, int, int, bool]]:
    """(role before, role after, weight, merged) of a turn; role 0 stands for an unknown one."""
    out = []
    for p in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            change = 0 if q == role else RELABEL
            if (p, q) in GAP:
                gap = GAP[p, q]
                out.append((p, q, (change + INSERT * len(gap)) * _COST + 1 + len(gap), False))
            if p == q:
                out.append((p, q, (change + MERGE) * _COST, True))
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


MOVES = [_moves(r) for r in range(4)]


def _forward(roles: list[int], start: np.ndarray) -> tuple[np.ndarray, list[list]]:
    """Least weights to each last role, and for each turn the best move to each role."""
    value, back = [int(x) for x in start], []
    for r in roles:
        new, best = [int(_INF)] * 4, [None] * 4
        for move in MOVES[r]:
            w = value[move[0]] + move[2]
            if w < new[move[1]]:
                new[move[1]], best[move[1]] = w, move
        value = new
        back.append(best)
    return np.array(value, dtype=np.int64), back


def _single(p: int) -> np.ndarray:
    start = np.full(4, _INF)
    start[p] = 0
    return start


def solve(roles: list[int], enter: int, leave: int) -> list[tuple[int, int, int, bool]]:
    """The moves of the cheapest way through the turns from one role to another."""
    _, back = _forward(roles, _single(enter))
    path, q = [], leave
    for best in reversed(back):
        path.append(best[q])
        q = best[q][0]
    return path[::-1]


def _closing(value: np.ndarray) -> int:
    total = [int(v) + (INSERT * _COST + 1) * len(CLOSE[q]) for q, v in enumerate(value)]
    return int(np.argmin(total))


def chain(tables: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(role before, role after, turns put out before) for each part of one conversation."""
    values = [_single(START)]
    for t in tables:
        values.append(np.minimum((values[-1][:, None] + t).min(axis=0), _INF))
    q, out = _closing(values[-1]), []
    for value, t in zip(reversed(values[:-1]), reversed(tables)):
        p = int(np.argmin(value + t[:, q]))
        out.append((p, q, int(value[p] % _COST)))
        q = p
    return out[::-1]


def _role_code(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _runs(batches):
    """The partition as one table, and the (first, end) rows of each conversation."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    if not table.num_rows:
        return None, []
    conv, null = table["conv"].fill_null(0).to_numpy(), table["conv"].is_null().to_numpy()
    cut = np.flatnonzero((conv[1:] != conv[:-1]) | (null[1:] != null[:-1])) + 1
    edges = [0, *cut.tolist(), table.num_rows]
    return table, list(zip(edges[:-1], edges[1:]))


def repair_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per piece of the repaired conversations, each partition in order.

    Columns: conversation id, turn (null for an inserted one), role_in, role,
    action (keep, relabel, merge, relabel+merge, insert), out_turn (number of the turn the
    piece belongs to) and rendered.  The pieces' ``rendered`` strings, joined in order, are the
    conversation in ChatML; ``<|`` inside a text is written ``< |`` so that it opens no turn.

    Turns are taken in the order of turn (nulls first), then role and text, which also orders
    rows that repeat a turn; every row is used.  Role names are trimmed and compared without
    case; a null or other role is unknown and must be relabelled.  A null text is empty.  Rows
    with a null conversation id form one conversation.  An empty table gives an empty result.
    """
    spark = turns.sparkSession
    shared_dir(spark)
    rows = turns.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = (rows.repartitionByRange("conv", "turn", "role", F.xxhash64("text"))
            .sortWithinPartitions("conv", "turn", "role", "text").checkpoint())

    def tables(batches):
        from pyspark import TaskContext
        table, runs = _runs(batches)
        out = []
        for a, b in {runs[0], runs[-1]} if runs else ():
            roles = [_role_code(r) for r in table["role"][a:b].to_pylist()]
            cost = np.stack([_forward(roles, _single(p))[0] for p in range(4)])
            out.append((TaskContext.get().partitionId(), a, table["conv"][a].as_py(), cost.ravel().tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
            names=["part", "at", "conv", "cost"])

    edge = sorted((r for r in rows.select("conv", "role").mapInArrow(
        tables, "part bigint, at bigint, conv bigint, cost array<bigint>").collect()),
        key=lambda r: (r["part"], r["at"]))
    plan: dict[tuple[int, int], tuple[int, int, int, bool, bool]] = {}
    i = 0
    while i < len(edge):
        j = i + 1
        while j < len(edge) and edge[j]["conv"] == edge[i]["conv"]:
            j += 1
        ways = chain([np.array(r["cost"], dtype=np.int64).reshape(4, 4) for r in edge[i:j]])
        for k, way in enumerate(ways):
            plan[edge[i + k]["part"], edge[i + k]["at"]] = (*way, k == 0, i + k == j - 1)
        i = j
    shared = spark.sparkContext.broadcast(plan)

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        table, runs = _runs(batches)
        out = []
        for a, b in runs:
            names = table["role"][a:b].to_pylist()
            roles = [_role_code(r) for r in names]
            enter, leave, made, first, last = shared.value.get((part, a)) or (
                START, _closing(_forward(roles, _single(START))[0]), 0, True, True)
            conv, turn = table["conv"][a].as_py(), table["turn"][a:b].to_pylist()
            text = table["text"][a:b].to_pylist()
            rest = list(CLOSE[leave]) if last else []
            for n, (p, q, _, merged) in enumerate(solve(roles, enter, leave)):
                for gap in () if merged else GAP[p, q]:
                    out.append([conv, None, None, NAMES[gap], "insert", made, _open(gap, made)])
                    made += 1
                act = [*(["relabel"] if roles[n] != q else []), *(["merge"] if merged else [])]
                body = (text[n] or "").replace("<|", "< |")
                made += not merged
                out.append([conv, turn[n], names[n], NAMES[q], "+".join(act) or "keep", made - 1,
                            "\n" + body if merged else _open(q, made - 1) + body])
            for gap in rest:
                out.append([conv, None, None, NAMES[gap], "insert", made, _open(gap, made)])
                made += 1
            if last and out:
                out[-1][-1] += "<|im_end|>\n"
            if len(out) > 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ("conv", "turn", "role_in", "role", "action", "out_turn", "rendered")
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=list(names))

    done = rows.mapInArrow(write, "conv bigint, turn bigint, role_in string, role string, action string, "
                                  "out_turn bigint, rendered string")
    return done.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)


def _open(role: int, made: int) -> str:
    """The marks that begin a turn; the turn before it, if any, is closed first."""
    return ("<|im_end|>\n" if made else "") + f"<|im_start|>{NAMES[role]}\n"
