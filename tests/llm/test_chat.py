"""Chat formatting against plain Python."""

import hashlib
import re

from textscore.llm import chat, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [
    (1, 0, "system", "s\\1[]<"), (1, 1, "user", "a</s>[user]b"), (1, 2, "assistant", "é😀 \\0\n"), (1, 3, "assistant", ""), (1, 4, "user", None),
    (2, 0, "user", "only"), (3, 5, "assistant", "first"), (3, None, None, "null turn"), (3, 5, "assistant", "first"),
    (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "ro]le\n[", "t"), (4, 1, "assistant", "w " * 50_000),
]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_everything_comes_back(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected(ROWS)


def test_examples_are_prefixes(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    made = {(r.conv_id, r.example): r for r in chat.examples(rows).collect()}
    own = [made[1, i] for i in range(3)]
    assert [r.n_turns for r in own] == [3, 4, 5]
    assert own[2].formatted.startswith(own[1].formatted) and own[1].formatted.startswith(own[0].formatted)
    assert own[2].loss_chars == 0 and own[2].loss_start == len(own[2].formatted)
    assert own[0].formatted[own[0].loss_start :] == chat_escaped("é😀 \\0\n") + "</s>"
    for r in made.values():
        assert r.formatted.count("</s>") == r.n_turns == len(re.findall(r"\[", r.formatted))


def chat_escaped(text):
    return text.replace("\\", "\\0").replace("<", "\\1").replace("[", "\\2").replace("]", "\\3")


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(rows)).collect() == []


def test_formatting_is_native(spark):
    plan = queries.op9_chat_examples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
