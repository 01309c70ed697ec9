import hashlib

import pytest
from pyspark.sql import functions as F

from stayline.llm import chat

CONTROLS = chat.Template().strings()
TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "user", " ".join(CONTROLS)), (2, 1, "assistant", "<" + "".join(CONTROLS) + "<s>s>[INST[INST]] \\ \\\\ \\<s>"),
    (3, 1, "assistant", "first"), (3, 0, "user", None), (3, 2, "user", ""), (3, 3, "assistant", "line\nline\n"),
    (4, 0, "assistant", "too early"), (4, 1, "user", "x"),
    (5, 0, None, "no role"), (5, 1, "odd\nrole <s> \\", "t"),
    (6, 0, "user", "twice"), (6, 0, "user", "twice"), (6, 1, "assistant", "a"),
    (None, 0, "user", "q"), (None, None, "assistant", "z" * 100_000),
    (7, 0, "user", "q"), (7, 1, "assistant", "a"), (7, 2, "tool", "r"), (7, 3, "assistant", "b"),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_hand():
    talks = {}
    for conv, turn, role, text in TURNS:
        talks.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in talks.items()}


@pytest.fixture(scope="module")
def talks(spark):
    rows = spark.createDataFrame(TURNS, SCHEMA).withColumn("segments", F.lit(1)).withColumn("valid", F.lit(2))
    return chat.format_conversations(rows).cache()


def test_formatted_text_gives_the_turns_back(talks):
    got = talks.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), "formatted").collect()
    want = by_hand()
    assert len(got) == len(want)
    for row in got:
        assert [(t["role"], t["text"]) for t in row["t"]] == want[row["conv_id"]]
        marks = sum(row["formatted"].count(c) for c in CONTROLS)
        assert marks == 2 * len(want[row["conv_id"]])


def test_segments_join_to_the_text_and_mark_the_loss(talks):
    for row in talks.collect():
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
        assert sum(s["loss"] for s in row["segments"]) == sum(r == "assistant" for r, _ in by_hand()[row["conv_id"]])


def test_digests(talks):
    for row in chat.conversation_digests(talks).collect():
        turns = by_hand()[row["conv_id"]]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_turn_order(talks):
    got = {r["conv_id"]: (r["valid"], r["broken_at"]) for r in talks.collect()}
    assert got[1] == (True, None) and got[2] == (True, None) and got[3] == (True, None) and got[7] == (True, None)
    assert got[4] == (False, 0) and got[5] == (False, 0) and got[6] == (False, 1)
    assert got[None] == (False, 0)


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(chat.format_conversations(rows)).count() == 0


def test_no_python_in_the_plan(talks):
    plan = chat.conversation_digests(talks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_templates_that_could_be_forged_are_refused():
    with pytest.raises(ValueError):
        chat.Template(open="{{", close="}}").strings()
    for controls in (("a\\b",), ("x",), ("<a\n>",), ("q<|end",), ("<|end|>x",)):
        with pytest.raises(ValueError):
            chat.Template(controls=controls).strings()


def test_other_template(spark):
    template = chat.Template(open="{o}", close="{c}", controls=("[[x", "]]"), learnt=("bot",), moves={"start": {"bot": "end"}}, accepting=("end",))
    rows = spark.createDataFrame([(1, 0, "bot", "a {o}b{c} [[x]] {o\\")], SCHEMA)
    row = chat.format_conversations(rows, template).select("*", chat.read_turns(F.col("formatted"), template).alias("t")).first()
    assert row["valid"] and row["t"][0]["text"] == "a {o}b{c} [[x]] {o\\"
