"""Preference pairs: records of several shapes become prompt, chosen, rejected and an optional system text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import first_truthy, strip, word_count

TURN = "struct<role:string,content:string>"
MOST_WORDS = 350
MOST_RATIO = 8.0


FIELDS = ("system", "prompt", "chosen", "rejected", "question", "instruction")


def _field(record: Column, name: str) -> Column:
    """struct(kind, text, turns, turn) of a record's field: which JSON type it has, and its value as such."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    return F.struct(
        F.upper(F.substring(F.schema_of_variant(value), 1, 5)).alias("kind"),
        F.try_variant_get(record, f"$.{name}", "string").alias("text"),
        F.try_variant_get(record, f"$.{name}", f"array<{TURN}>").alias("turns"),
        F.try_variant_get(record, f"$.{name}", TURN).alias("turn"),
    ).alias(name)


def _last(turns: Column, role: str) -> Column:
    return strip(F.try_element_at(F.filter(turns, lambda t: t["role"] == role), F.lit(-1))["content"])


def _as_prompt(f: Column) -> Column:
    one = F.when(f["turn"]["role"] == "user", strip(f["turn"]["content"]))
    return F.when(f["kind"] == "ARRAY", _last(f["turns"], "user")).when(f["kind"] == "OBJEC", one).otherwise(strip(f["text"]))


def _as_answer(f: Column) -> Column:
    end = F.try_element_at(f["turns"], F.lit(-1))
    said = lambda t: F.when(t["role"] == "assistant", strip(t["content"]))
    return F.when(f["kind"] == "ARRAY", said(end)).when(f["kind"] == "OBJEC", said(f["turn"])).otherwise(strip(f["text"]))


def _pair(f: Column) -> Column:
    """struct(system, prompt, chosen, rejected) of a record's fields."""
    first_system = strip(F.try_element_at(F.filter(f["prompt"]["turns"], lambda t: (t["role"] == "system") & (strip(t["content"]) != "")), F.lit(1))["content"])
    system = first_truthy(f["system"]["text"], first_system, _last(f["chosen"]["turns"], "system"), _last(f["rejected"]["turns"], "system"))
    asked = first_truthy(_as_prompt(f["prompt"]), _last(f["chosen"]["turns"], "user"), strip(first_truthy(f["question"]["text"], f["instruction"]["text"])))
    answer = lambda name: F.coalesce(_as_answer(f[name]), F.lit(""))
    return F.struct(F.nullif(system, F.lit("")).alias("system"), asked.alias("prompt"), answer("chosen").alias("chosen"), answer("rejected").alias("rejected"))


def _pairs(records: DataFrame, raw: str) -> Column:
    """array<struct> of a record's pair; each value is bound once, so the record is parsed once."""
    once = lambda value, then: F.transform(F.array(value), then)
    return F.flatten(F.flatten(once(F.try_parse_json(F.col(raw)), lambda v: once(F.struct(*[_field(v, n) for n in FIELDS]), lambda f: F.array(_pair(f))))))


def normalised(records: DataFrame, raw: str = "json") -> DataFrame:
    """Adds system, prompt, chosen and rejected to JSON records whose fields are strings, turns or lists of turns.

    A field's JSON type decides, not what a string begins with. A null field is as a missing one. The last user's turn is
    the prompt; a completion list must end with the assistant; a missing prompt comes from the chosen list, then from
    question, then from instruction.
    """
    return records.select(*records.columns, F.inline(_pairs(records, raw)))


def keeps(prompt: Column, chosen: Column, rejected: Column, chosen_words: Column | None = None, rejected_words: Column | None = None) -> Column:
    """Whether a pair is complete, differs and is neither long nor lopsided."""
    a, b = word_count(chosen) if chosen_words is None else chosen_words, word_count(rejected) if rejected_words is None else rejected_words
    fair = (F.least(a, b) == 0) | (F.greatest(a, b) <= F.least(a, b) * F.lit(MOST_RATIO))
    return (prompt != "") & (chosen != "") & (rejected != "") & (chosen != rejected) & (a <= MOST_WORDS) & (b <= MOST_WORDS) & fair


def pairs(records: DataFrame, raw: str = "json") -> DataFrame:
    """The pairs that are kept, with the words of both answers, counted once."""
    counted = F.transform(_pairs(records, raw), lambda p: F.struct(*[p[k].alias(k) for k in ("system", "prompt", "chosen", "rejected")], word_count(p["chosen"]).alias("chosen_words"), word_count(p["rejected"]).alias("rejected_words")))
    kept = F.filter(counted, lambda p: keeps(p["prompt"], p["chosen"], p["rejected"], p["chosen_words"], p["rejected_words"]))
    return records.select(*records.columns, F.inline(kept))


def budgets(total: int, ratio: float = 0.5) -> tuple[int, int]:
    """Records to take of the first and the second source."""
    return int(total * ratio), total - int(total * ratio)


def pair_turns(system: Column, prompt: Column, answer: Column) -> Column:
    """The turns of one side of a pair; the system turn only if it isn't blank."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.array(turn("user", prompt), turn("assistant", answer))
    return F.when(F.coalesce(strip(system), F.lit("")) != "", F.concat(F.array(turn("system", system)), body)).otherwise(body)


def masked_logp(logps: Column, labels: Column, ignore: int = -100) -> Column:
    """Sum of the log-probabilities of labelled tokens; logps[i] is that of token i + 1."""
    return F.aggregate(F.zip_with(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), logps, lambda label, p: F.when(label != ignore, p).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def dpo_terms(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> dict[str, Column]:
    """loss, rewards, margin and win of a pair, from the log-probabilities of both models."""
    good, bad = beta * (policy_chosen - ref_chosen), beta * (policy_rejected - ref_rejected)
    x = good - bad
    loss = F.when(x > 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))
    return {"loss": loss, "reward_chosen": good, "reward_rejected": bad, "margin": x, "win": (x > 0).cast("double")}
