"""Sampling masks over logits, answer extraction, and the arithmetic of evaluations over given scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def argmax(scores: Column) -> Column:
    """Index of the largest, the first of ties; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def top_k(scores: Column, k: int) -> Column:
    """Which entries are among the k largest; ties with the k-th stay. One sort a row."""
    least = F.element_at(F.sort_array(scores, asc=False), F.least(F.lit(k), F.size(scores)))
    return bound(F.struct(scores.alias("all"), F.when(F.size(scores) > 0, least).alias("least")), lambda s: F.transform(s["all"], lambda v: v >= s["least"]))


def softmax(scores: Column) -> Column:
    powers = bound(F.struct(scores.alias("all"), F.array_max(scores).cast("double").alias("most")), lambda s: F.transform(s["all"], lambda v: F.exp(v.cast("double") - s["most"])))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return bound(powers, lambda p: bound(F.struct(p.alias("all"), total(p).alias("total")), lambda s: F.transform(s["all"], lambda v: v / s["total"])))


def nucleus_kept(scores: Column, p: float) -> Column:
    """array<boolean>: entries in descending order of probability up to the one that crosses p, that one kept.

    One sort and one fold over it: the fold keeps the last entry before which the sum is not yet over p, and what isn't
    behind that entry stays.
    """
    entries = F.transform(softmax(scores), lambda q, i: F.struct((-q).alias("low"), i.alias("index")))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("low"), F.lit(-1).alias("index"))

    def step(acc: Column, x: Column) -> Column:
        still = acc["sum"] <= p
        return F.struct((acc["sum"] - x["low"]).alias("sum"), F.when(still, x["low"]).otherwise(acc["low"]).alias("low"), F.when(still, x["index"]).otherwise(acc["index"]).alias("index"))

    def kept(all_: Column) -> Column:
        last = F.aggregate(F.sort_array(all_), none, step)
        return bound(F.struct(all_.alias("all"), last.alias("last")), lambda s: F.transform(s["all"], lambda x: (x["low"] < s["last"]["low"]) | ((x["low"] == s["last"]["low"]) & (x["index"] <= s["last"]["index"]))))

    return F.when(F.size(scores) > 0, bound(entries, kept)).otherwise(F.array().cast("array<boolean>"))


def nucleus(rows: DataFrame, by: list[str], scores: str, p: float) -> DataFrame:
    """by, index, kept: one row for each entry of nucleus_kept()."""
    return rows.select(*by, F.posexplode(nucleus_kept(F.col(scores), p)).alias("index", "kept")).withColumn("index", F.col("index").cast("long"))


def summary(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """task, metric, value: the figures of several evaluations (one row each) as one table."""
    parts = [df.select(F.lit(task).alias("task"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]))) for task, df in results]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def penalised(scores: Column, seen: Column, penalty: float, spared: list[int] | None = None) -> Column:
    """Scores of ids that occurred: divided if positive, else multiplied; spared ids stay."""
    spare = F.array(*map(F.lit, spared)) if spared else F.array().cast("array<int>")
    hit = lambda i: F.array_contains(seen, i) & ~F.array_contains(spare, i)
    return F.transform(scores, lambda v, i: F.when(hit(i), F.when(v > 0, v / F.lit(penalty)).otherwise(v * F.lit(penalty))).otherwise(v))


def tempered(scores: Column, temperature: Column | float) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(temperature), F.lit(1e-5))
    return F.transform(scores, lambda v: v / t)


def gold_answer(text: Column) -> Column:
    """The number after ####, without commas; null if there is none."""
    form = r"####\s*(-?[0-9\.,]+)"
    return F.when(text.rlike(form), F.replace(F.regexp_extract(text, form, 1), F.lit(","), F.lit("")))


def predicted_answer(text: Column) -> Column:
    """The last number after the last closing thought, or in the whole text; null if there is none."""
    end = F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1)).otherwise(text)
    return F.try_element_at(F.regexp_extract_all(end, F.lit(NUMBER), F.lit(1)), F.lit(-1))


def percent(ok: Column) -> Column:
    """Share of true rows in percent, 0 without rows; rounded to two places."""
    return F.round(F.coalesce(F.sum(ok.cast("double")) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, F.lit(0.0)), 2)


def answer_accuracy(rows: DataFrame, gold: str, completion: str) -> DataFrame:
    """Accuracy of predicted numbers, as texts, and the share of closed thoughts; rows without a gold number don't count."""
    known = rows.where(gold_answer(F.col(gold)).isNotNull())
    right = F.coalesce(predicted_answer(F.col(completion)) == gold_answer(F.col(gold)), F.lit(False))
    return known.agg(percent(right).alias("accuracy"), percent(F.contains(F.col(completion), F.lit("</think>"))).alias("closed"), F.count(F.lit(1)).alias("samples"))


def perplexity(rows: DataFrame, loss: str, tokens: str, clamp: bool = False) -> DataFrame:
    """Token-weighted mean loss and perplexity; above a loss of 20 infinite, or with clamp that of 20."""
    total = F.sum(tokens)
    mean = F.when(total > 0, F.sum(F.col(loss) * F.col(tokens)) / total).otherwise(F.lit(0.0))
    ppl = F.when(total > 0, F.exp(F.least(mean, F.lit(20.0)))).otherwise(F.lit(0.0)) if clamp else F.when(mean < 20, F.exp(mean)).otherwise(F.lit(float("inf")))
    return rows.agg(F.round(mean, 4).alias("loss"), F.round(ppl, 2).alias("perplexity"))


def preference_margin(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Mean margin and share of strict wins."""
    return rows.agg(F.round(F.avg(F.col(chosen) - F.col(rejected)), 4).alias("margin"), percent(F.col(chosen) > F.col(rejected)).alias("wins"), F.count(F.lit(1)).alias("samples"))


def choice_accuracy(rows: DataFrame, scores: str, right: str) -> DataFrame:
    """Share of rows whose best-scored choice is the right one."""
    return rows.agg(percent(F.coalesce(argmax(F.col(scores)) == F.col(right), F.lit(False))).alias("accuracy"), F.count(F.lit(1)).alias("samples"))


def labelled_choice_accuracy(rows: DataFrame, scores: str, labels: str, right: str) -> DataFrame:
    """As choice_accuracy, with labels compared without case and outer spaces."""
    said = F.get(F.col(labels), argmax(F.col(scores)).cast("int"))
    return rows.agg(percent(F.coalesce(F.lower(F.trim(said)) == F.lower(F.trim(F.col(right))), F.lit(False))).alias("accuracy"), F.count(F.lit(1)).alias("samples"))
