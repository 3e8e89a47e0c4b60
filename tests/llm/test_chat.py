import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratiform.llm import chat, queries

PARTS = ["a", "\\", "<", "|", "im_end", "|>", "\n", "é", *chat.CONTROLS, "assistant\n"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=6).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_round_trip(turns):
    done = chat.format_turns(turns)
    assert chat.parse(done.text) == turns
    assert [chat.unescape(done.text[a:b]) for a, b in done.loss] == [t for r, t in turns if r == "assistant"]
    assert [a for a, _ in done.spans] == [0, *[b for _, b in done.spans]][: len(turns)]
    for a, b in done.loss:  # right after the mark of the turn, right before its end
        assert done.text[:a].endswith(f"{chat.START}assistant\n") and done.text[b:].startswith(chat.END)


@given(TEXT)
def test_no_control_string_is_left(text):
    assert not any(control in chat.escape(text) for control in chat.CONTROLS)
    assert chat.unescape(chat.escape(text)) == text


def test_a_template_that_rewrites_history_is_detected():
    turns = [("user", "a"), ("assistant", "b")]
    with pytest.raises(chat.HistoryRewritten):
        chat.format_turns(turns, lambda m: f"{len(m)} turns " + chat.template(m))
    with pytest.raises(chat.HistoryRewritten):  # drops earlier thoughts
        chat.format_turns(turns, lambda m: chat.template([(r, "" if k < len(m) - 1 else t) for k, (r, t) in enumerate(m)]))
    with pytest.raises(ValueError):  # changes the text
        chat.format_turns(turns, lambda m: chat.template([(r, t.upper()) for r, t in m]))


def test_any_template_of_growing_output_works():
    def other(messages):
        return "<s>" + "".join(f"[INST] {t} [/INST]" if r == "user" else f" {t}</s>" for r, t in messages)

    done = chat.format_turns([("user", "s"), ("assistant", "s"), ("user", ""), ("assistant", "")], other)
    assert [done.text[a:b] for a, b in done.loss] == ["s", ""]
    assert done.text[: done.loss[0][0]].endswith("[/INST] ")


def numbered(messages):
    """Says how many turns came before, so a prefix must begin at the first turn."""
    return "".join(f"{chat.START}{role}\n{k} {text}{chat.END}\n" for k, (role, text) in enumerate(messages))


@pytest.mark.parametrize("render", [chat.template, numbered])
def test_windows_give_what_whole_prefixes_give(render):
    turns = [("assistant" if k % 2 else "user", f"text {k}") for k in range(23)]
    whole = chat.format_turns(turns, render)
    assert chat.format_turns(turns, render, window=5) == whole
    assert whole.text == render(turns)
    assert [whole.text[a:b] for a, b in whole.loss] == [t for r, t in turns if r == "assistant"]


def test_a_long_conversation():
    turns = [("assistant" if k % 2 else "user", "word " * 20) for k in range(6000)]
    assert chat.parse(chat.format_turns(turns).text) == turns


def test_awkward_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, spans string, formatted string"
    rows = [
        (1, 2, "assistant", "late", "x", "x"), (1, 1, "user", "early", "x", "x"), (1, None, None, None, "x", "x"),
        (2, 1, "assistant", None, None, None), (None, 1, "assistant", "no id", "x", "x"),
        (3, 1, "assistant", "same", "x", "x"), (3, 1, "assistant", "same", "x", "x"), (3, 1, "assistant", "also", "x", "x"),
        (4, 1, "assistant", "w " * 400_000, "x", "x"),
    ]
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert out[1]["turns_sha256"] == digest("\n\nuser\nearly\nassistant\nlate\n")
    assert (out[2]["n_turns"], out[2]["loss_chars"]) == (1, 0)
    assert out[3]["loss_sha256"] == digest("alsosamesame") and out[4]["loss_chars"] == 800_000
    assert out[None]["loss_chars"] == 5
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_planted_conversation(spark):
    rows = {r["conv_id"]: r for r in queries.op8_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1]["n_turns"] == 2 and rows[-1]["loss_chars"] == len(said)
    assert rows[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
