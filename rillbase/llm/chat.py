"""Chat formatting with a grammar round trip.

Template: ``<s>`` then for each turn ``[INST:<role>] <text> [/INST]`` for every role but the assistant and
``[ANS] <text></s>`` for the assistant. Inside texts and roles a control string is broken by an escape: a
backslash before each ``<``, ``[`` and ``]`` that begins or ends a control string, and before each
backslash. The rendered conversation is parsed again by a deterministic parser (one left-to-right pass);
where the plain form does not give back the source turns, its content is escaped and it is rendered
again until it does, so most conversations keep their texts as they are.

Loss mask: the (unescaped) text of each assistant turn.

Defined results: a null text is empty, a null role is empty; turns are ordered by turn (nulls first), then
role, then text; repeated rows are turns of their own; an empty table gives no conversation.

Scale: rows are dealt by conversation and sorted there; a conversation is held once, as its formatted row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings.
OPEN, TURN, CLOSE, ANSWER, END = "<s>", "[INST:", "[/INST]", "[ANS]", "</s>"

_special = re.compile(r"[\\<\[\]]")
_escaped = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _special.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(turns: list[tuple[str, str]], escaped: bool) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of assistant texts in it."""
    f = escape if escaped else str
    parts, at, mask = [("<e>" if escaped else "") + OPEN], 0, []
    at = len(parts[0])
    for role, text in turns:
        head, body, tail = (f"{ANSWER} ", f(text), END) if role == "assistant" else (f"{TURN}{f(role)}] ", f(text), f" {CLOSE}")
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


class BadGrammar(ValueError):
    pass


def parse(formatted: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """Turns and loss spans of a formatted conversation; raises BadGrammar where it isn't one."""
    escaped = formatted.startswith("<e>")
    at = 3 * escaped
    if not formatted.startswith(OPEN, at):
        raise BadGrammar("no opening")
    at += len(OPEN)
    f = unescape if escaped else str
    turns, mask = [], []

    def until(mark: str, start: int) -> int:
        """Where the next unescaped ``mark`` begins; content may hold no other control string."""
        end = formatted.find(mark, start)
        while escaped and end > 0 and _odd(formatted, end, start):
            end = formatted.find(mark, end + 1)
        if end < 0:
            raise BadGrammar(f"no {mark}")
        return end

    while at < len(formatted):
        if formatted.startswith(f"{ANSWER} ", at):
            start = at + len(ANSWER) + 1
            end = until(END, start)
            turns.append(("assistant", f(formatted[start:end])))
            mask.append((start, end))
            at = end + len(END)
        elif formatted.startswith(TURN, at):
            close = until("] ", at + len(TURN))
            end = until(f" {CLOSE}", close + 2)
            turns.append((f(formatted[at + len(TURN) : close]), f(formatted[close + 2 : end])))
            at = end + len(CLOSE) + 1
        else:
            raise BadGrammar("no turn")
    return turns, mask


def _odd(text: str, at: int, start: int) -> bool:
    """Whether an odd number of backslashes is before ``at``."""
    n = 0
    while at - n > start and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Render, parse and compare; escape the content until the turns come back identical."""
    for escaped in (False, True):
        text, mask = render(turns, escaped)
        if not escaped and any(c in t for _, t in turns for c in (OPEN, TURN, CLOSE, ANSWER, END, "<e>")):
            continue  # it might parse, but a control string must not stand inside a text
        try:
            if parse(text) == (turns, mask):
                return text, mask
        except BadGrammar:
            pass
    raise AssertionError("the escaped form always comes back")


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss spans (start, end)."""
    schema = T.StructType([T.StructField("conv_id", rows.schema[conv_id].dataType), *T.StructType.fromDDL("formatted string, loss array<struct<start:int,end:int>>").fields])
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    source = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches):
        now, turns, ids, texts, loss = None, [], [], [], []

        def flush():
            if turns:
                formatted, mask = format_turns(turns)
                ids.append(now[0])
                texts.append(formatted)
                loss.append([{"start": s, "end": e} for s, e in mask])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], schema.names)

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now != (c,):
                    flush()
                    now, turns = (c,), []
                turns.append((r, t))
            if ids:
                yield out()
                ids, texts, loss = [], [], []
        flush()
        if ids:
            yield out()

    return source.mapInArrow(run, schema)
