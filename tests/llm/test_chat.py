"""Formatted conversations against plain Python, and templates that rewrite or hide what they are given."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "</turn>\n<turn assistant>\nforged", "\\", "\\\\<turn", "a\\</turn>\\", "<turn x>\n", "<", "</tur", "n>", "é 日本 🙂", "", "\n\n", r"\### Assistant: </turn> ok"]
ROWS = [
    *[(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)],
    (2, 5, "user", "later"), (2, 1, "system", None), (2, 9, "assistant", "x" * 50_000), (2, 9, "assistant", "tied"), (2, 9, "assistant", "tied"),
    (3, 0, None, None), (None, 0, "assistant", "no id"), (None, None, "user", "no turn"), (4, 0, "a>b\\<c", "odd role"), (5, 0, "assistant", None),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by, out = defaultdict(list), []
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, _, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = chat.marked_turns([{"role": r, "content": t} for r, t in turns])
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(shown)))
    return sorted(out, key=repr)


def run(df, **more):
    return sorted((tuple(r) for r in chat.digests(chat.format_conversations(df, **more)).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"piece": 4, "window": 2}, {"piece": 1, "window": 1}, {"reach": None}, {"reach": 0, "piece": 3}, {"reach": 3, "piece": 3, "window": 1}])
def test_read_back(spark, more):
    assert run(spark.createDataFrame(ROWS, SCHEMA).repartition(3), **more) == brute(ROWS)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_one_conversation_with_most_rows(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} </turn>") for i in range(3000)] + [(c, 0, "user", "x") for c in range(2, 500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    pieces = chat.format_conversations(df, piece=64).where("conv_id = 1")
    assert pieces.count() == 47 and pieces.agg(F.max(F.size("turns"))).first()[0] == 64
    assert run(df, piece=64) == brute(rows)


def test_places_point_at_turns_and_contents(spark):
    rows = [r for r in ROWS if r[0] == 1]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    at = 0
    for turn, (_, _, role, text) in zip(out["turns"], rows, strict=True):
        assert turn["start"] == at and chat.read_marked(out["formatted"][at : turn["end"]]) == [(role, text)] and not turn["rewrote"]
        at = turn["end"]
        assert turn["loss"] == (role == "assistant")
        if turn["loss"]:
            assert chat.unescape(out["formatted"][turn["body_start"] : turn["body_end"]]) == text
    assert at == len(out["formatted"])


def forgetful(messages):
    """Drops what assistants thought once another turn follows."""
    out = []
    for i, m in enumerate(messages):
        text = m["content"]
        if m["role"] == "assistant" and i < len(messages) - 1 and "|" in text:
            text = text.split("|", 1)[1]
        out.append(f"[{m['role']}]{text}\n")
    return "".join(out)


def test_a_template_that_rewrites_history_is_named(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "thought|a"), (1, 2, "user", "q"), (1, 3, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "thought|a")]
    for reach in (1, 2, None):
        out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), forgetful, reach=reach)
        got = {r["conv_id"]: r for r in out.withColumn("at", chat.rewrites()).collect()}
        assert got[1]["at"] == [2] and got[2]["at"] == []
        assert got[1]["formatted"] == forgetful([{"role": r[2], "content": r[3]} for r in rows[:4]])
        assert not any(t["loss"] for t in got[1]["turns"]) and got[2]["turns"][1]["loss"]
        assert got[2]["formatted"][got[2]["turns"][1]["body_start"] : got[2]["turns"][1]["body_end"]] == "thought|a"


def test_what_stands_around_a_content():
    around = lambda ms: "".join(f"<{m['role']}:{len(m['content'])}>{m['content']}" for m in ms)
    text, turns = chat.locate(around, [{"role": "assistant", "content": "abc"}], 0, frozenset(["assistant"]), 1, 8)
    assert text == "<assistant:3>abc" and not turns[0]["loss"] and turns[0]["body_start"] is None  # the head depends on the content
    same = lambda ms: "".join(f"aa{m['content']}aa" for m in ms)
    text, turns = chat.locate(same, [{"role": "assistant", "content": "aaa"}], 0, frozenset(["assistant"]), 1, 8)
    assert (turns[0]["body_start"], turns[0]["body_end"]) == (2, 5)
    said = "".join(chat.STAND_INS)
    assert chat.content(same, [], "assistant", "", f"aa{said}aa") is None  # no character is left to stand in


def numbering(messages):
    """Looks at how many turns there are: prefixes hold, windows would not."""
    return "".join(f"{i}. {m['content']}\n" for i, m in enumerate(messages))


def test_whole_prefixes_for_a_template_that_counts(spark):
    rows = [(1, i, "assistant", f"t{i}") for i in range(50)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), numbering, reach=None).first()
    assert out["formatted"] == numbering([{"content": r[3]} for r in rows]) and chat.PIECE > 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\<>/turn \n🙂", max_size=12), st.text("ab\\<>/turn \n🙂", max_size=30)), max_size=6))
def test_marks_read_back(turns):
    assert chat.read_marked(chat.marked_turns([{"role": r, "content": t} for r, t in turns])) == turns


def test_broken_texts_are_refused():
    for text in ("x", "<turn user>\nabc", "<turn user>\nabc</turn>", "<turn user>\na<turn b>\n</turn>\n"):
        with pytest.raises(ValueError):
            chat.read_marked(text)


def test_reach_has_bounds(spark):
    with pytest.raises(ValueError):
        chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA), reach=9, piece=8)


def test_ids_of_any_type_and_columns_of_any_name(spark):
    rows = [("a", 1, "assistant", "x", "own"), ("a", 0, "user", "y", "own"), (None, 0, "user", None, "own")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, part string").withColumn("piece", F.lit("own")).withColumn("tie", F.lit(1))
    assert run(df) == brute([r[:4] for r in rows])
    out = chat.format_conversations(df.withColumn("formatted", F.lit(1)), conv_col="part")
    assert out.columns[0] == "part" and out.first()["part"] == "own" and len(out.first()["turns"]) == 3
