"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages (role, text) to a string. Nothing is known
of it: successive prefixes of a conversation are rendered and compared, and what a turn adds is
its span. A template that changes what it had written for earlier turns is detected. Within the
span of an assistant's turn its text is located, which gives the loss mask.

Texts are escaped before rendering, so that no control string of the template is in them, and
the formatted conversation can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm import arrays

Template = Callable[[Sequence[tuple[str, str]]], str]

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of this and other common templates; none may stand in an escaped text.
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(x) for x in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


class HistoryRewritten(ValueError):
    """A template changed its output for earlier turns."""


class Formatted(NamedTuple):
    text: str
    spans: list[tuple[int, int]]  # of each turn
    loss: list[tuple[int, int]]  # of each assistant text, escaped


def escape(text: str) -> str:
    """Backslashes are doubled and every control string is broken by one after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def template(messages: Sequence[tuple[str, str]]) -> str:
    """The shipped template: each turn between its own marks."""
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in messages)


def format_turns(
    turns: Sequence[tuple[str, str]], render: Template = template, loss_role: str = "assistant", window: int = 256
) -> Formatted:
    """Format one conversation, rendering each prefix of its turns.

    Raises HistoryRewritten if the output for a prefix is not the beginning of the next one's,
    and ValueError if an assistant's text cannot be located in what its turn adds.

    Rendering all prefixes takes time with the square of the turns. So after ``window`` turns
    the prefixes begin at the last turn before the present window, and at its end the whole
    conversation so far is rendered: if that is not what the turns have added up to, the window
    is done again with whole prefixes. The result is the template's output in either case.
    """
    messages = [(escape_role(role), escape(text)) for role, text in turns]
    marked = [role == loss_role for role, _ in turns]
    text, spans, loss = "", [], []
    for low in range(0, len(turns), window):
        high = min(low + window, len(turns))
        whole = render(messages[:high])
        if not whole.startswith(text):
            raise HistoryRewritten(f"turns {low} to {high - 1} change the output for the turns before them")
        try:
            added = _added(messages, marked, low, high, max(low - 1, 0), render)
        except ValueError:
            added = None
        if added is None or text + "".join(part for part, _ in added) != whole:
            added = _added(messages, marked, low, high, 0, render)
        for part, place in added:
            spans.append((len(text), len(text) + len(part)))
            if place is not None:
                loss.append((len(text) + place[0], len(text) + place[1]))
            text += part
    return Formatted(text, spans, loss)


def _added(
    messages: list[tuple[str, str]], marked: list[bool], low: int, high: int, first: int, render: Template
) -> list[tuple[str, tuple[int, int] | None]]:
    """What each turn from ``low`` on adds to the output of the messages from ``first``, and where its text stands."""
    before = render(messages[first:low]) if low > first else ""
    out = []
    for k in range(low, high):
        after = render(messages[first : k + 1])
        if not after.startswith(before):
            raise HistoryRewritten(f"turn {k} changes the output for the turns before it")
        place = None
        if marked[k]:
            start, end = _locate(messages[first : k + 1], before, after, render)
            place = start - len(before), end - len(before)
        out.append((after[len(before) :], place))
        before = after
    return out


def _locate(messages: list[tuple[str, str]], before: str, after: str, render: Template) -> tuple[int, int]:
    """Where the last turn's text stands: a probe is rendered in its place, and what is around it compared."""
    role, text = messages[-1]
    probe = "\x00probe\x00"
    while probe in after:
        probe += "\x00"
    probed = render([*messages[:-1], (role, probe)])
    start = probed.find(probe, len(before))
    end = start + len(text)
    if start < 0 or after[:start] != probed[:start] or after[start:end] != text or after[end:] != probed[start + len(probe) :]:
        raise ValueError("the text of a turn cannot be located in the output of its turn")
    return start, end


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a conversation formatted by the shipped template."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def format_conversations(rows: DataFrame, render: Template = template) -> DataFrame:
    """conv_id, formatted, spans, loss for every conversation of ``rows`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first, then role and text, so ties and repeated rows have a
    defined place; each row is a turn. A null role or text is an empty one. Rows without conv_id
    are one conversation. Other columns are ignored; no rows give no conversations. A whole
    conversation is one record, as its formatted text is.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            done = [
                format_turns([(turn["role"], turn["text"]) for turn in turns], render)
                for turns in part.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([x.text for x in done], pa.string()),
                    *(
                        pa.array([[{"start": a, "end": b} for a, b in spans] for spans in column], _SPANS)
                        for column in ([x.spans for x in done], [x.loss for x in done])
                    ),
                ],
                ["conv_id", "formatted", "spans", "loss"],
            )

    kind = rows.schema["conv_id"].dataType.simpleString()
    spans = "array<struct<start: long, end: long>>"
    return whole.mapInArrow(arrays.mapper(run), f"conv_id {kind}, formatted string, spans {spans}, loss {spans}")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask hold, read back from them."""

    def run(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(5)]
        for text, loss in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            turns = parse(text)
            said = "".join(unescape(text[span["start"] : span["end"]]) for span in loss.as_py())
            everything = "".join(f"{role}\n{content}\n" for role, content in turns)
            values = (
                len(turns), hashlib.sha256(everything.encode()).hexdigest(),
                len(said), hashlib.sha256(said.encode()).hexdigest(), len(text),
            )
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], _DIGESTS)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        arrays.mapper(run),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
