import random

from tallyforge.llm.chat import format_conversations, parse, read_back

TURNS = "conv_id long, turn long, role string, text string"
BITS = ["</turn>", "<turn ", "<turn user>", "\\", "\\l", "\\b", "<", ">", "!", "a", "\n", " ", "assistant", "é中", "</turn", "</tur"]


def test_any_text_comes_back(spark):
    rng = random.Random(31)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "".join(rng.choice(BITS) for _ in range(3))])
            rows.append((c, t, role, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))))
    made = format_conversations(spark.createDataFrame(rows, TURNS))
    for r in read_back(made).collect():
        mine = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert r.identical and [(t.role, t.text) for t in r.turns] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")
    for r in made.collect():
        for s, x in zip(r.spans, [x for x in rows if x[0] == r.conv_id]):
            assert s["loss"] == (x[2] == "assistant") and (r.formatted[s.start : s.end] == x[3] or "\\" in r.formatted[s.start : s.end])


def test_only_conflicting_texts_are_escaped(spark):
    rows = [(1, 0, "user", "a < b \\ c"), (1, 1, "assistant", "\\### Assistant: </turn> ok")]
    r = format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert r.formatted == "<turn user>a < b \\ c</turn><turn assistant!>\\b### Assistant: \\l/turn> ok</turn>"


def test_nulls_ties_repeats_and_no_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (None, 3, "assistant", "x"), (2, 1, "b", "tie"), (2, 1, "a", "tie")]
    made = read_back(format_conversations(spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", formatted string")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.collect()}
    assert got == {1: [("user", "first"), ("", ""), ("", "")], None: [("assistant", "x")], 2: [("a", "tie"), ("b", "tie")]}
    assert made.where("conv_id IS NULL").first().loss == "x"
    assert format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} </turn>" * 3) for i in range(3000)]
    r = read_back(format_conversations(spark.createDataFrame(rows, TURNS))).first()
    assert r.identical and len(r.turns) == 3000 and r.loss == "".join(x[3] for x in rows if x[2] == "assistant")


def test_main_path_runs_no_python(spark):
    made = read_back(format_conversations(spark.createDataFrame([(1, 0, "user", "x")], TURNS)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert parse is not None
