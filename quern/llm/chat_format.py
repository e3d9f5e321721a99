"""Chat formatting (operator 4), in DataFrame functions only.

A declarative template names the marks of a turn, the roles whose text is trained on and the transitions of a finite-state
machine over roles. ``chat_format`` gives for each conversation the formatted string, its text segments with a loss flag
each, and whether the machine accepts the order of turns; ``read_back`` recovers roles and texts from the string.

Control strings inside texts and roles are replaced by a backslash and a letter, after each backslash became ``\\b``; a
formatted text therefore holds no mark, and every backslash in it is followed by its letter, which makes this reversible.

Defined results: a null role or text is empty; turns are ordered by turn (nulls first), then role, then text, so ties and
repeated rows have one order; a null conv_id is a conversation of its own. Conversations that the machine refuses are
formatted too and have valid = false with the index of the first wrong turn. Extra columns are ignored; an empty table
gives an empty result. The turns of one conversation meet in one row, as its formatted text does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss roles and the machine: (state, role) -> state; a missing pair is an error."""

    turn_open: str = "### "
    role_end: str = ":\n"
    turn_close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )

    @property
    def controls(self) -> list[tuple[str, str]]:
        """What texts may not hold, and the codes that stand for it: backslash first, then the marks."""
        return [("\\", "\\b"), (self.turn_open, "\\o"), (self.turn_close.strip(), "\\c")]


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT, role: bool = False) -> Column:
    for mark, code in template.controls + ([(template.role_end, "\\r")] if role else []):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescaped(text: Column, template: Template = DEFAULT, role: bool = False) -> Column:
    for mark, code in reversed(template.controls + ([(template.role_end, "\\r")] if role else [])):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _machine(turns: Column, template: Template) -> Column:
    """Folds the roles into struct(state, at, bad): bad is the index of the first turn without a move, else null."""
    moves = F.create_map(*[x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))])
    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        wrong = acc["bad"].isNull() & to.isNull()
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), F.when(wrong, acc["at"]).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(turns, zero, step)


def chat_format(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid, bad_turn of each conversation."""
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    loss = lambda t: t["role"].isin(*template.loss_roles)
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.turn_open), escaped(t["role"], template, role=True), F.lit(template.role_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"], template).alias("text"), loss(t).alias("loss")),
                F.struct(F.lit(template.turn_close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    told = convs.select("conv_id", parts.alias("segments"), _machine(F.col("turns"), template).alias("end"))
    ok = F.col("end.bad").isNull() & F.col("end.state").isin(*template.accepting)
    return told.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", ok.alias("valid"), F.col("end.bad").alias("bad_turn"))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> from a formatted string alone."""
    pieces = F.split(formatted, r"\Q" + template.turn_close + r"\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, template.role_end, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(template.turn_open) + 1)), template, role=True).alias("role"), unescaped(F.substr(piece, F.length(head) + len(template.role_end) + 1), template).alias("text"))

    return F.transform(pieces, turn)


def chat_digest(chats: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The digests of what chat_format gave, read back from its strings and flags; bad_turn is -1 where none is wrong."""
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    read = chats.select("conv_id", "formatted", "valid", "bad_turn", read_back(F.col("formatted"), template).alias("turns"), lost.alias("lost"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.coalesce("bad_turn", F.lit(-1)).cast("long").alias("bad_turn"),
    )
