"""Chat formatting: shapes, layouts, escapes, pieces, masks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from aerolith.llm import chat_format as cf

RECORDS = {
    '{"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}': ("messages", [("user", "a"), ("assistant", "")]),
    '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}': ("messages_parts", [("user", "ab")]),
    '{"messages": [{"text": "t", "role": "tool", "weight": 0.5}]}': ("messages_text", [("tool", "t")]),
    '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "x"}], "a.b": {"c": 1}}': ("shared", [("user", "q"), ("assistant", "r"), ("tool", "x")]),
    '{"system": "be kind", "conversations": [{"from": "human", "value": "q"}]}': ("system_shared", [("system", "be kind"), ("user", "q")]),
    '{"instruction": "do", "input": "this", "output": "done"}': ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    '{"instruction": "do", "input": " ", "output": "done"}': ("instruction", [("user", "do"), ("assistant", "done")]),
    '{"instruction": "do", "response": "done", "context": null}': ("instruction_response", [("user", "do"), ("assistant", "done")]),
    '{"prompt": "p", "completion": "c", "system": "s"}': ("prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    '{"prompt": "p", "response": ""}': ("prompt_response", [("user", "p"), ("assistant", "")]),
    '{"question": "q", "answer": 42}': ("question_answer", [("user", "q"), ("assistant", "42")]),
    '{"role": "user", "text": "t"}': ("message", [("user", "t")]),
    '{"role": "user", "content": "t"}': ("message_content", [("user", "t")]),
    '{"messages": []}': ("messages", []),
    '{"messages": null}': ("messages", []),
    '{"prompt": "p"}': (None, []),
    '{"prompt": "p", "completion": "c", "messages": []}': (None, []),
    "{}": (None, []),
    "[1, 2]": (None, []),
    "{broken": (None, []),
    "": (None, []),
}


def test_layouts(spark):
    rows = [(i, r, "clash", "clash") for i, r in enumerate(RECORDS)] + [(100, None, "", ""), (101, '{"prompt": "p"}', "", "")]
    df = spark.createDataFrame(rows, "id long, body string, turns string, layout string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(df, "body", keep=("id",)).collect()}
    assert got == {i: want for i, want in enumerate(RECORDS.values())} | {100: (None, []), 101: (None, [])}
    assert cf.canonical_turns(df.limit(0), "body", keep=("id",)).count() == 0


def test_paths(spark):
    text = json.dumps({"b": {"c d": [{"e": 1, "f": None}], "g": {}}, "a": [1, 2], "h.i": 2.5})
    df = spark.createDataFrame([(text,), (None,), ("{",)], "j string")
    got = [r.p for r in df.select(cf.field_paths(F.try_parse_json("j")).alias("p")).collect()]
    assert got == [sorted(["a[]", "b.`c d`[].e", "b.`c d`[].f", "b.g", "`h.i`"]), None, None]


def test_structs_and_own_layouts(spark):
    own = cf.Layout("pair", ("in.text", "out.text"), (), (cf.One("user", ("in.text",)), cf.One("assistant", ("out.text",))))
    df = spark.createDataFrame([(1, (("x",), ("y",)))], "id long, r struct<`in` struct<text string>, out struct<text string>>")
    assert [tuple(t) for t in cf.canonical_turns(df.select("id", F.col("r").alias("r")), "r", layouts=(*cf.LAYOUTS, own)).first().turns] == [("user", "x"), ("assistant", "y")]
    with pytest.raises(ValueError, match="shape"):
        cf.register((*cf.LAYOUTS, cf.Layout("again", ("prompt", "response"), (), ())))
    with pytest.raises(ValueError, match="inside"):
        cf.Template(controls=(*cf.CONTROLS, "<x<s>"))


def odd_text(rng):
    parts = [*cf.CONTROLS, "<", "[", "\\", "|", ">", "/s>", "INST]", "im_end|>", "\n", "é", "\U0001f600", "a", " ", "$1", "\\Q", "\\E", "<\\s>", "<\\\\/s>"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_formatted_text_reads_back(spark):
    rng = random.Random(5)
    chats = [(i, [(rng.choice(["user", "assistant", "system", odd_text(rng)]), odd_text(rng)) for _ in range(rng.choice([0, 1, 2, 5, 150]))]) for i in range(150)]
    df = spark.createDataFrame(chats, f"conv_id long, turns {cf.TURNS}")
    by_turn = df.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", F.array("t").alias("turns"))
    whole = {r.conv_id: r for r in cf.format_chats(df, turn=None).collect()}
    rows = {r.conv_id: r for r in cf.format_chats(by_turn.repartition(7)).collect()}
    assert len(whole) == len(chats) and all(whole[k].text == r.text and whole[k].mask == r.mask for k, r in rows.items())
    read = {}
    for r in sorted(cf.read_pieces(cf.format_pieces(by_turn)).collect(), key=lambda r: r.piece):
        turns, learned = read.setdefault(r.conv_id, ([], []))
        assert len(r.turns) <= cf.PIECE
        turns.extend((t.role, t.text) for t in r.turns)
        learned.extend(r.learned)
    for i, turns in chats:
        if not turns:
            assert i not in rows and whole[i].text == "" and whole[i].mask == []
            continue
        text = rows[i].text
        assert read[i] == (turns, [t for role, t in turns if role == "assistant"])
        for c in cf.CONTROLS:
            assert text.count(c) == (len(turns) if c in ("<|im_start|>", "<|im_end|>") else 0)
        assert len(rows[i].mask) == len(read[i][1])
        assert all("\\" in text[m.start : m.start + m.length] or text[m.start : m.start + m.length] == t for m, t in zip(rows[i].mask, read[i][1], strict=True))


def test_odd_rows(spark):
    rows = [(1, 1, "b", "y"), (1, 0, "user", None), (1, 1, "b", "x"), (1, 1, "b", "x"), (1, None, None, "first"), (None, 3, "assistant", "z"), (2, 5, "assistant", "w " * 400_000), (3, 0, None, None)]
    rows += [(4, 10**9 * k, "assistant", str(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("chunk", F.lit("clash"))
    turns = cf.canonical_turns(df, F.struct("role", "text"), keep=("conv_id", "turn"))
    got = {r.conv_id: r for r in cf.digests(cf.format_pieces(turns)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("\nfirst\nuser\n\nb\nx\nb\nx\nb\ny\n") and got[1].n_turns == 5 and got[1].loss_sha256 == sha("") and got[1].loss_chars == 0
    assert got[None].loss_sha256 == sha("z") and got[2].loss_chars == 800_000 and got[3].turns_sha256 == sha("\n\n") and got[3].n_turns == 1
    assert got[4].loss_sha256 == sha("".join(map(str, range(300)))) and got[4].n_turns == 300
    assert cf.digests(cf.format_pieces(turns.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").select(F.col("conv_id"), "turn", "role", "text")
    plan = cf.digests(cf.format_pieces(cf.canonical_turns(df, F.struct("role", "text"), keep=("conv_id", "turn"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
