"""Round trips of chat formatting."""

import random

from claimweave.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, spans int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        out[c] = [(r[2] or "", r[3] or "") for r in own]
    return out


def test_round_trip(spark):
    rng = random.Random(3)
    bits = ["\\", "#", "<", ">", "+", "</turn>", "### Assistant: ", "<+>", " </turn>\n### User: ", "\\h", "\\b", "\\l", "\n", "a", "é😀", "$1", "\\E", " "]
    roles = ["user", "assistant", "system", "assistant", None, "Tool: x", "Assistant", "\\ruser", "a#<b:"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(bits, k=rng.randint(0, 6))) or None) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (None, None, "user", "lost"), (99, 1, "user", "same"), (99, 1, "user", "same"), (98, 1, "assistant", "x" * 100_000)]
    got = C.read_chats(C.format_chats(chats(spark, rows))).collect()
    want = expected(rows)
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.loss_text for r in got} == {c: "".join(t for role, t in v if role == "assistant") for c, v in want.items()}


def test_layout_and_plan(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "yo")]
    df = C.format_chats(chats(spark, rows))
    row = df.first()
    assert row.formatted == "### User: hi<+>there </turn>\n### Assistant: yo </turn>\n"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == ["yo"]
    plan = C.read_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_empty(spark):
    assert C.read_chats(C.format_chats(chats(spark, []))).collect() == []
