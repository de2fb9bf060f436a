"""Chat formatting: exact round trips and the order of roles."""

import random

from pyspark.sql import functions as F
from tidefold.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<<s>>", "\\", "<s", "a<", "", None, "line\nline [/ANS]</s>", "[ROLE]x[/ROLE]y[/TURN]", "é 😀 [SYS]", "$1 \\$2"]


def rows(spark):
    rng = random.Random(5)
    made = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            made.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", None, "[/ROLE]"]), "".join(filter(None, rng.choices(NASTY, k=3))) if rng.random() < 0.8 else rng.choice(NASTY)))
    return made


def test_round_trip(spark):
    data = rows(spark)
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, segments int, state string")
    made = chat.format_chats(df, "conv_id", "turn", "role", "text")
    got = made.select("conv_id", "n_turns", "segments", chat.formatted(F.col("segments")).alias("text"), chat.learnt(F.col("segments")).alias("learnt")).withColumn("turns", chat.read_back(F.col("text"))).collect()
    want = {}
    for conv, turn, role, text in data:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id] and r.n_turns == len(want[r.conv_id])
        assert r.learnt == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.text == "".join(s.text for s in r.segments)
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want[r.conv_id])
        # no control string but the marks themselves
        assert sum(r.text.count(c) for c in ("[INST]", "[/INST]")) == 2 * sum(role == "user" for role, _ in want[r.conv_id])


def test_machine(spark):
    orders = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant"], 4: ["user", "user"], 5: ["system", "assistant"], 6: ["tool"], None: ["user"]}
    df = spark.createDataFrame([(c, t, r, "x") for c, rs in orders.items() for t, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.state) for r in chat.format_chats(df, "conv_id", "turn", "role", "text").collect()}
    assert got == {1: (True, "assistant"), 2: (True, "user"), 3: (False, "invalid"), 4: (False, "invalid"), 5: (False, "invalid"), 6: (False, "invalid"), None: (True, "user")}


def test_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df, "conv_id", "turn", "role", "text").select(chat.read_back(chat.formatted(F.col("segments"))).alias("t")).first()
    assert [t.text for t in row.t] == ["a", "a", "b"]
    assert chat.format_chats(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_long_text(spark):
    text = "<s>[INST" * 50_000 + "x" * 500_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df, "conv_id", "turn", "role", "text").select(chat.read_back(chat.formatted(F.col("segments"))).alias("t"), chat.learnt(F.col("segments")).alias("l")).first()
    assert row.t[0].text == text == row.l
