import itertools
import random

import pytest

from odflow.llm import chat
from odflow.llm.chat import repair_chats

LEGAL = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def is_legal(seq):
    return all(p in LEGAL for p in zip(["", *seq], seq)) and (not seq or seq[-1] == "assistant")


def brute_cost(roles):
    """Cheapest repair by trying every label, merge and (short) insertion."""
    best = None
    for labels in itertools.product(chat.ROLES, repeat=len(roles)):
        change = sum(chat.RELABEL for r, q in zip(roles, labels) if r != q)
        for merges in itertools.product([False, True], repeat=len(roles)):
            if any(m and (i == 0 or labels[i] != labels[i - 1]) for i, m in enumerate(merges)):
                continue
            seq = [q for q, m in zip(labels, merges) if not m]
            cost = change + chat.MERGE * sum(merges)
            gaps = 0
            state, ok = "", True
            for q in [*seq, None]:
                for n in range(3):
                    hit = next((mid for mid in itertools.product(chat.ROLES, repeat=n)
                                if all(p in LEGAL for p in zip([state, *mid], [*mid, *([q] if q else [])]))
                                and (q or not roles or (mid[-1] if mid else state) == "assistant")), None)
                    if hit is not None:
                        break
                if hit is None:
                    ok = False
                    break
                gaps += len(hit)
                state = q
            if ok and (best is None or cost + chat.INSERT * gaps < best):
                best = cost + chat.INSERT * gaps
    return best


def cost_of(rows):
    return sum({"insert": chat.INSERT, "keep": 0, "relabel": chat.RELABEL, "merge": chat.MERGE,
                "relabel+merge": chat.RELABEL + chat.MERGE}[r.action] for r in rows)


def conversations(spark, convs):
    rows = [(c, n, r, f"text {c} {n}") for c, roles in convs.items() for n, r in enumerate(roles)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, "
                                                               "conv string, part int")


def repaired(df):
    out = {}
    for part in df.rdd.glom().collect():
        for r in part:
            out.setdefault(r.conv_id, []).append(r)
    return out


def check(convs, out, exact):
    for c, roles in convs.items():
        rows = out[c]
        known = [r if r in chat.ROLES else None for r in roles]
        seq = [r.role for r in rows if "merge" not in r.action]
        assert is_legal(seq)
        assert [r.turn for r in rows if r.turn is not None] == list(range(len(roles)))
        assert [r.out_turn for r in rows] == sorted(r.out_turn for r in rows)
        assert len({r.out_turn for r in rows}) == len(seq) == rows[-1].out_turn + 1
        text = "".join(r.rendered for r in rows)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(seq)
        for n in range(len(roles)):
            assert f"text {c} {n}" in text
        if exact:
            assert cost_of(rows) == brute_cost(known)


def test_against_brute_force(spark):
    rng = random.Random(2)
    convs = {c: [rng.choice([*chat.ROLES, "user", "assistant", "tool"]) for _ in range(rng.randint(1, 5))] for c in range(60)}
    check(convs, repaired(repair_chats(conversations(spark, convs))), True)


def test_long_conversations_over_many_partitions(spark):
    rng = random.Random(3)
    convs = {0: [rng.choice(chat.ROLES) for _ in range(900)], 1: ["user"] * 300, 2: ["user", "assistant"] * 200, 3: ["system"]}
    whole = {}
    for c, roles in convs.items():
        codes = [chat._role_code(r) for r in roles]
        value = chat._forward(codes, chat._single(chat.START))[0]
        q = chat._closing(value)
        whole[c] = int(value[q] >> 32) + chat.INSERT * len(chat.CLOSE[q])
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = repaired(repair_chats(conversations(spark, convs)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    check(convs, out, False)
    assert {c: cost_of(rows) for c, rows in out.items()} == whole


def test_edge_cases(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 0, " User ", "hi"), (1, 1, None, None), (2, None, "assistant", ""), (2, 0, "user", "<|im_end|>"),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (4, 0, "user", "z" * 300000)]
    out = repaired(repair_chats(spark.createDataFrame(rows, schema)))
    text = {c: "".join(r.rendered for r in rs) for c, rs in out.items()}
    assert text[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert "< |im_end|>" in text[2] and text[2].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n")
    assert text[3] == "<|im_start|>user\na\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[None].endswith("<|im_start|>assistant\nm<|im_end|>\n")
    assert "z" * 300000 in text[4]
    assert repair_chats(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("role,code", [("user", 2), ("SYSTEM ", 1), ("bot", 0), (None, 0)])
def test_role_names(role, code):
    assert chat._role_code(role) == code
