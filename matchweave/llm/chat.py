"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles checks the order of the turns and emits a list of text segments, each with its loss
flag, whose texts joined are the formatted conversation.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Template:
    """Marks around a turn, strings with a meaning, and the machine.

    A turn is ``begin`` role ``named`` text ``end``.  ``moves`` gives the state after a role, by state
    and role; any other role breaks the order.  Texts of turns that enter one of ``loss_states`` are under
    the loss.  No mark may end as it begins.
    """

    begin: str = "<s>["
    named: str = "] "
    end: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_states: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"))


def escape(text: Column, template: Template) -> Column:
    """``text`` without control strings: a backslash after the first character of each, and backslashes doubled."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in template.control:
        text = F.replace(text, F.lit(word), F.lit(word[0] + "\\" + word[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column, template: Template) -> Column:
    return F.replace(F.replace(escape(role, template), F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%")))


#: Turns whose segments are gathered at a time, so that a long conversation's are not copied with each turn.
_STRETCH = 64


def _run(turns: Column, template: Template) -> Column:
    """The machine's run over the turns: its state, the turns so far, the first turn that broke the order
    (0: none) and the segments it has emitted.

    A turn whose role has no move from the state breaks the order; it enters the state that its role leads to
    elsewhere, or none, and then its text is never under the loss.
    """
    moves = F.create_map(*[F.lit(x) for state, role, after in template.moves for x in (f"{state}>{role}", after)])
    known = F.create_map(*[F.lit(x) for pair in {role: after for _, role, after in template.moves}.items() for x in pair])
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def emitted(turn, entered):
        before = F.concat(F.lit(template.begin), _escape_role(turn["role"], template), F.lit(template.named))
        return F.array(segment(before, F.lit(False)),
                       segment(escape(turn["text"], template), F.coalesce(entered.isin(*template.loss_states), F.lit(False))),
                       segment(F.lit(template.end), F.lit(False)))

    def step(now, turn):
        after = F.try_element_at(moves, F.concat(now["state"], F.lit(">"), turn["role"]))
        entered, n = F.coalesce(after, F.try_element_at(known, turn["role"])), now["n"] + 1
        return F.struct(
            F.coalesce(entered, now["state"]).alias("state"), n.alias("n"),
            F.when((now["broken"] == 0) & after.isNull(), n).otherwise(now["broken"]).alias("broken"),
            F.concat(now["segments"], emitted(turn, entered)).alias("segments"))

    none = F.array().cast("array<struct<text:string,loss:boolean>>")
    at = lambda now, segments: F.struct(*[now[c].alias(c) for c in ("state", "n", "broken")], segments.alias("segments"))
    stretch = lambda now, start: F.aggregate(
        F.slice(turns, start, F.lit(_STRETCH)), at(now, none), step, lambda end: at(end, F.concat(now["segments"], end["segments"])))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(0).alias("broken"), none.alias("segments"))
    return F.aggregate(F.sequence(F.lit(1), F.size(turns), F.lit(_STRETCH)), begin, stretch)


def format_conversations(df: DataFrame, template: Template = Template(), conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segments, formatted, final_state, broken_turn) of each conversation of a table of turns.

    Turns are ordered by number, then role, then text (a null number comes first); repeated rows stay
    repeated turns; null roles and texts are empty.  ``segments`` holds (text, loss).  A conversation
    whose roles break the order is formatted all the same, and ``broken_turn`` says where (0: nowhere).
    Rows with a null conv_id are one conversation.

    A formatted conversation is one value, so its turns meet in one row, as any output of this kind must.
    """
    rows = df.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    out = turns.select("conv_id", _run(F.col("turns"), template).alias("run")).select("conv_id", "run", F.col("run.segments").alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
                      F.col("run.state").alias("final_state"), F.col("run.broken").alias("broken_turn"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(formatted, re.escape(template.end))

    def turn(part):
        body = F.substring(part, len(template.begin) + 1, 1 << 30)
        at = F.instr(body, template.named)
        return F.struct(_unescape_role(F.substr(body, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substr(body, at + len(template.named))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_texts(segments: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"]))
