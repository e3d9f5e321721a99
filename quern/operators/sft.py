"""Instruction data: messages, cleaning, ChatML, token labels, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import strip, strip_right
from quern.operators.tokens import PAD, TURN_END, TURN_START

IGNORE = -100
NEWLINE = 10


def messages(*turns: tuple[str, Column]) -> Column:
    """array<struct<role, content>>; a turn whose content is null is left out."""
    return F.filter(F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns]), lambda m: m["content"].isNotNull())


def dialogues(turns: DataFrame) -> DataFrame:
    """conv_id, messages in the order of turns, from one row a turn."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def cleaned(dialogue: Column) -> Column:
    """Roles stripped; contents without line ends around them and white space after; empty turns dropped."""
    turns = F.transform(dialogue, lambda t: F.struct(strip(t["role"]).alias("role"), strip_right(F.regexp_replace(t["content"], r"^[\r\n]+|[\r\n]+\z", "")).alias("content")))
    return F.filter(turns, lambda t: F.coalesce(t["content"], F.lit("")) != "")


def gate(df: DataFrame, dialogue: str = "messages") -> DataFrame:
    """Dialogues of two or more turns that have a user's and an assistant's turn after cleaning; cleaned."""
    rows = df.where(F.size(dialogue) >= 2).withColumn(dialogue, cleaned(F.col(dialogue)))
    return rows.where(F.exists(dialogue, lambda t: t["role"] == "user") & F.exists(dialogue, lambda t: t["role"] == "assistant"))


def at_least(df: DataFrame, turns: int = 2, dialogue: str = "messages") -> DataFrame:
    return df.where(F.size(dialogue) >= turns)


def chatml(dialogue: Column, system: Column | None = None, cue: bool = False) -> Column:
    """The ChatML text of a dialogue, with an optional system turn first and the assistant's cue last."""
    body = F.array_join(F.transform(dialogue, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), strip(t["content"]), F.lit("<|im_end|>\n"))), "")
    head = F.lit("") if system is None else F.when(F.coalesce(strip(system), F.lit("")) != "", F.concat(F.lit("<|im_start|>system\n"), strip(system), F.lit("<|im_end|>\n"))).otherwise(F.lit(""))
    return F.concat(head, body, F.lit("<|im_start|>assistant\n" if cue else ""))


def wrapped_prompt(prompt: Column) -> Column:
    """A prompt as a user's turn with the assistant's cue, unless it is ChatML already."""
    return F.when(F.contains(prompt, F.lit("<|im_start|>")), prompt).otherwise(F.concat(F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n")))


def last_turns(dialogue: Column, turns: int) -> Column:
    """The last 2 * turns messages."""
    keep = F.least(F.lit(2 * turns), F.size(dialogue))
    return F.when(keep > 0, F.slice(dialogue, F.size(dialogue) - keep + 1, keep)).otherwise(dialogue)


def labelled(encoded: Column, most: int) -> Column:
    """struct(input_ids, labels) of turns array<struct<role, role_ids, content_ids>>, cut at ``most``.

    A turn is start, role, newline, content, end, newline; only an assistant's content and end are labelled.
    """
    start, end, newline = (F.array(F.lit(x)) for x in (TURN_START, TURN_END, NEWLINE))
    ids = F.flatten(F.transform(encoded, lambda t: F.concat(start, t["role_ids"], newline, t["content_ids"], end, newline)))
    blank = lambda n: F.array_repeat(F.lit(IGNORE), n)
    labels = F.flatten(
        F.transform(
            encoded,
            lambda t: F.when(t["role"] == "assistant", F.concat(blank(F.size(t["role_ids"]) + 2), t["content_ids"], end, blank(F.lit(1)))).otherwise(blank(F.size(t["role_ids"]) + F.size(t["content_ids"]) + 4)),
        )
    )
    return F.struct(F.slice(ids, 1, most).alias("input_ids"), F.slice(labels, 1, most).alias("labels"))


def batched(df: DataFrame, rank: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch, rank div size; drop_last leaves out an incomplete batch if there is a full one."""
    rows = df.withColumn("batch", F.floor(F.col(rank) / size))
    if not drop_last:
        return rows
    n = df.count()
    return rows.where(F.col(rank) < n - n % size) if n >= size else rows


def padded(df: DataFrame, sides: list[tuple[str, str]], multiple: int = 16, most: int | None = None) -> DataFrame:
    """Pads ids and labels to their batch's longest, rounded up; adds mask columns.

    sides are (ids, labels) columns that share one length; ``most`` caps it and cuts rows that are longer.
    """
    every = F.greatest(*[F.size(c) for pair in sides for c in pair], F.lit(0))
    longest = F.max(every).over(W.partitionBy("batch"))
    length = (F.ceil(longest / multiple) * multiple).cast("int")
    rows = df.withColumn("_length", F.least(length, F.lit(most)) if most else length)
    for ids, labels in sides:
        for name, fill in ((ids, PAD), (labels, IGNORE)):
            rows = rows.withColumn(f"_{name}", F.slice(F.col(name), F.lit(1), F.col("_length")))
            rows = rows.withColumn(name, F.concat(F.col(f"_{name}"), F.array_repeat(F.lit(fill), F.col("_length") - F.size(f"_{name}"))))
        rows = rows.withColumn(f"{ids}_mask", F.concat(F.array_repeat(F.lit(1), F.size(f"_{ids}")), F.array_repeat(F.lit(0), F.col("_length") - F.size(f"_{ids}"))))
        rows = rows.drop(f"_{ids}", f"_{labels}")
    return rows.drop("_length")


def prompt_ids(ids: Column, context: int, answer: int) -> Column:
    """The last ids of a prompt that leave room for ``answer`` more in a context; what is cut off is the oldest."""
    if not 0 <= answer < context:
        raise ValueError("an answer must be shorter than the context")
    return F.slice(ids, F.greatest(F.size(ids) - (context - answer), F.lit(0)) + 1, F.lit(context - answer))


def scoring_window(prompt_ids: Column, continuation_ids: Column, most: int, end: int) -> Column:
    """struct(ids, from_index): a prompt cut on the left and a continuation to score, within ``most`` tokens."""
    tail = F.slice(continuation_ids, 1, most - 1)
    prompt = F.when(F.size(prompt_ids) > 0, prompt_ids).otherwise(F.array(F.lit(end)))
    room = F.least(F.size(prompt), F.lit(most) - F.size(tail))
    head = F.slice(prompt, F.size(prompt) - room + 1, room)
    return F.struct(F.concat(head, tail).alias("ids"), (F.size(head) - 1).alias("from_index"))
