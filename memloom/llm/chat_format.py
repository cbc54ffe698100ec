"""Chat formatting: a finite-state machine over roles and a declarative template.

Every turn becomes three segments (opening mark, escaped text, closing mark) with a loss flag each. Control strings
inside a text are broken by a backslash after their first character and backslashes are doubled, so the output can be
read back without loss. Only DataFrame functions are used.

The work is cut into chunks of consecutive turn numbers: a chunk yields its segments and, for each state in which the
machine may enter it, the state in which it leaves. Chunks of a conversation then compose in a fold, so a conversation
of any length is formatted by many tasks.

Defined cases: null text is empty; null or unknown roles get a generic mark that carries the role (null: empty) and
make the conversation invalid; rows of one turn number are ordered by role, then text, null turns come last; repeated
rows are separate turns; a null conv_id is a conversation of its own; an empty table gives an empty table; columns
besides the four named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the generic mark's parts, and the machine: state -> {role: next state}."""

    marks: dict[str, Mark] = field(
        default_factory=lambda: {
            "system": Mark("<<SYS>>", "<</SYS>>"),
            "user": Mark("[INST] ", " [/INST]"),
            "assistant": Mark("<s>", "</s>", loss=True),
        }
    )
    other_opening: str = "<<ROLE>>"
    other_middle: str = "<</ROLE>>"
    other_closing: str = "<</TURN>>"
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        own = [s.strip() for m in self.marks.values() for s in (m.opening, m.closing)]
        return own + [self.other_opening, self.other_middle, self.other_closing]

    @property
    def openings(self) -> list[str]:
        return [m.opening.strip() for m in self.marks.values()] + [self.other_opening]

    @property
    def states(self) -> list[str]:
        found = dict.fromkeys([self.start, *self.moves])
        for to in self.moves.values():
            found.update(dict.fromkeys(to.values()))
        return list(found)


LLAMA = Template()


def escape(text: Column, template: Template = LLAMA) -> Column:
    """Double backslashes, then break each control string after its first character."""
    starts: dict[str, list[str]] = {}
    for c in sorted(template.controls, key=len, reverse=True):
        starts.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"{re.escape(a)}(?=(?:{'|'.join(b)}))" for a, b in starts.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segments(role: Column, text: Column, t: Template) -> Column:
    def three(a: Column, b: Column, loss: bool) -> Column:
        piece = lambda x, flag: F.struct(x.alias("text"), F.lit(flag).alias("loss"))
        return F.array(piece(a, False), piece(escape(text, t), loss), piece(b, False))

    other = three(F.concat(F.lit(t.other_opening), escape(role, t), F.lit(t.other_middle)), F.lit(t.other_closing), False)
    out = None
    for name, m in t.marks.items():
        case = three(F.lit(m.opening), F.lit(m.closing), m.loss)
        out = F.when(role == name, case) if out is None else out.when(role == name, case)
    return out.otherwise(other) if out is not None else other


def chat_format(
    df: DataFrame,
    template: Template = LLAMA,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk_turns: int = 256,
) -> DataFrame:
    """One row per chunk of a conversation: conv_id, chunk, n_turns, segments, text, steps.

    segments: the turns' segments in order, array<struct<text, loss>>; text: their concatenation; steps: for each
    state of the machine, struct<state, accepted> after this chunk (state -1: refused, accepted: turns before that).
    """
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    names = template.states
    arrows = {f"{names.index(s)}|{r}": names.index(to) for s, moves in template.moves.items() for r, to in moves.items()}
    table = F.create_map(*[F.lit(x) for pair in arrows.items() for x in pair])

    def run(state: int) -> Column:
        def step(acc: Column, x: Column) -> Column:
            to = F.coalesce(F.try_element_at(table, F.concat(acc["state"].cast("string"), F.lit("|"), x["role"])), F.lit(-1))
            gone = acc["state"] < 0
            return F.struct(F.when(gone, -1).otherwise(to).alias("state"), (acc["accepted"] + F.when(gone | (to < 0), 0).otherwise(1)).alias("accepted"))

        return F.aggregate("turns", F.struct(F.lit(state).alias("state"), F.lit(0).alias("accepted")), step)

    grouped = (
        rows.withColumn("chunk", F.floor(F.col("turn") / chunk_turns))
        .groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text"))).alias("turns"))
    )
    segments = F.flatten(F.transform("turns", lambda x: _segments(x["role"], x["text"], template)))
    return (
        grouped.select("conv_id", "chunk", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), F.array(*[run(i) for i in range(len(names))]).alias("steps"))
        .withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def validate(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Per conversation: n_turns, valid, end_state (null: refused), accepted_turns before the first refused one."""
    names = template.states
    chunks = F.sort_array(F.collect_list(F.struct(F.col("chunk").isNull().alias("last"), "chunk", "steps")))

    def fold(acc: Column, x: Column) -> Column:
        out = F.try_element_at(x["steps"], acc["state"] + 1)
        gone = acc["state"] < 0
        return F.struct(F.when(gone, -1).otherwise(out["state"]).alias("state"), (acc["accepted"] + F.when(gone, 0).otherwise(out["accepted"])).alias("accepted"))

    first = F.struct(F.lit(names.index(template.start)).alias("state"), F.lit(0).alias("accepted"))
    ends = formatted.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), chunks.alias("chunks"))
    ends = ends.withColumn("end", F.aggregate("chunks", first, fold))
    state = F.when(F.col("end.state") >= 0, F.element_at(F.array(*map(F.lit, names)), F.greatest(F.col("end.state"), F.lit(0)) + 1))
    return ends.select("conv_id", "n_turns", state.isin(*template.accepting).alias("ok"), state.alias("end_state"), F.col("end.accepted").cast("long").alias("accepted_turns")).withColumn("ok", F.coalesce("ok", F.lit(False))).withColumnRenamed("ok", "valid")


def parse(text: Column, template: Template = LLAMA) -> Column:
    """Read turns back from formatted text: array<struct<role, text>>."""
    cut_at = "|".join(re.escape(o) for o in sorted(template.openings, key=len, reverse=True))
    pieces = F.filter(F.split(text, f"(?={cut_at})"), lambda p: p != "")

    def turn(p: Column) -> Column:
        def inner(a: int, b: int) -> Column:
            return unescape(F.substring(p, F.lit(a + 1), F.length(p) - a - b))

        o, m, c = template.other_opening, template.other_middle, template.other_closing
        name = F.substring_index(F.substring(p, F.lit(len(o) + 1), F.length(p)), m, 1)
        body = F.substring(p, F.length(name) + len(o) + len(m) + 1, F.length(p) - F.length(name) - len(o) - len(m) - len(c))
        role, said = unescape(name), unescape(body)
        for r, mark in template.marks.items():
            hit = F.startswith(p, F.lit(mark.opening))
            role = F.when(hit, F.lit(r)).otherwise(role)
            said = F.when(hit, inner(len(mark.opening), len(mark.closing))).otherwise(said)
        return F.struct(role.alias("role"), said.alias("text"))

    return F.transform(pieces, turn)
