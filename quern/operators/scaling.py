"""Arithmetic of model sizes, training budgets and learning rates, as columns and grid searches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 64
KV_SHARE = 3
LEAST_LAYERS = 8
STEP_FFN = 256


def parameters[N: (int, Column)](vocab: N, width: N, layers: N, ffn: N, heads: N, kv_heads: N) -> N:
    """Parameters of a decoder with tied embeddings, grouped heads and a gated feed-forward block."""
    side = width * heads * HEAD + 2 * width * kv_heads * HEAD + heads * HEAD * width
    return vocab * width + width + layers * (side + 2 * width + 3 * width * ffn)


def architectures(budgets: DataFrame, vocab: int, budget: str = "budget") -> DataFrame:
    """budget, width, layers, ffn, heads, kv_heads, params: the best model for each budget of a table.

    Widths go from 192 to 4096; each is given the layers that come nearest to the budget, its proportions must fit, and the
    nearest of all wins, the narrowest of ties. If none fits, the smallest width with the fewest layers stands in.
    """
    padded = -(-vocab // 64) * 64
    rows = budgets.select(F.col(budget).cast("long").alias("budget")).distinct()
    fit, least = [], []
    for width in range(192, 4097, HEAD * KV_SHARE):  # twenty-one widths, whatever the number of budgets
        heads, kv_heads, ffn = width // HEAD, width // HEAD // KV_SHARE, round(8 / 3 * width / STEP_FFN) * STEP_FFN
        none, one, floor = (parameters(padded, width, n, ffn, heads, kv_heads) for n in (0, 1, LEAST_LAYERS))
        left = F.col("budget") - padded * width
        layers = F.greatest(F.lit(LEAST_LAYERS), F.bround(left / (one - none)).cast("long"))
        params = none + layers * (one - none)

        def named(off, layers, params, width=width, ffn=ffn, heads=heads, kv_heads=kv_heads):  # noqa: ANN001, ANN202
            parts = {"off": off, "width": F.lit(width), "layers": layers, "ffn": F.lit(ffn), "heads": F.lit(heads), "kv_heads": F.lit(kv_heads), "params": params}
            return F.struct(*[c.cast("long").alias(k) for k, c in parts.items()])

        fit.append(F.when((left > 0) & (layers / width).between(0.010, 0.040), named(F.abs(params - F.col("budget")), layers, params)))
        least.append(named(F.lit(floor), F.lit(LEAST_LAYERS), F.lit(floor)))
    return rows.select("budget", F.coalesce(F.array_min(F.array(*fit)), F.array_min(F.array(*least))).alias("a")).select("budget", "a.width", "a.layers", "a.ffn", "a.heads", "a.kv_heads", "a.params")


def architecture(spark: SparkSession, budget: int, vocab: int) -> DataFrame:
    """The row of architectures() for one budget, without it."""
    return architectures(spark.createDataFrame([(budget,)], "budget long"), vocab).drop("budget")


def _up_to(value: Column, multiple: int) -> Column:
    return F.ceil(value / multiple) * multiple


def model_plans(budgets: DataFrame, vocab: int = 50_259, length: int = 2048, budget: str = "budget") -> DataFrame:
    """The second search: every width from 384 in steps of a group of heads with every depth of its own range.

    Parameters grow evenly with the depth, so a width's nearest depths are the two around the budget, or an end of its range.
    A budget's candidates stay in its row, and only the nearest is left.
    budget, width, layers, heads, kv_heads, ffn, params, embedding, most_rate, least_rate, batch_tokens, tokens; the first
    nearest to the budget wins. Rates and batches follow the width and size that were found.
    """
    padded = -(-vocab // 128) * 128
    step = HEAD * KV_SHARE
    rows = budgets.select(F.col(budget).cast("long").alias("budget")).distinct()
    near = []
    for width in range(384, 4096, step):  # fixed by the search: twenty widths, whatever the number of budgets
        heads, kv_heads, ffn = width // HEAD, width // HEAD // KV_SHARE, -(-math.floor(8 / 3 * width) // STEP_FFN) * STEP_FFN
        fewest = max(4, math.floor(width * 0.010))
        most = max(fewest + 2, math.floor(width * 0.025) + 6) - 1
        none, one = (parameters(padded, width, n, ffn, heads, kv_heads) for n in (0, 1))
        below = F.expr(f"(budget - {none}L) div {one - none}L")
        for layers in (below, below + 1):
            layers = F.least(F.greatest(layers, F.lit(fewest).cast("long")), F.lit(most).cast("long"))
            params = none + layers * (one - none)
            fixed = [F.lit(v).cast("long").alias(k) for k, v in (("heads", heads), ("kv_heads", kv_heads), ("ffn", ffn))]
            near.append(F.struct(F.abs(params - F.col("budget")).alias("off"), F.lit(width).cast("long").alias("width"), layers.alias("layers"), *fixed, params.alias("params")))
    found = rows.select("budget", F.array_min(F.array(*near)).alias("a")).select("budget", "a.width", "a.layers", "a.heads", "a.kv_heads", "a.ffn", "a.params")
    rate = F.round(F.lit(6e-4) * F.sqrt(F.lit(768.0) / F.col("width")), 6)
    batch = F.when(F.col("params") >= 125_000_000, _up_to(F.floor(F.lit(250_000) * F.sqrt(F.col("params") / F.lit(125e6))), length).cast("long")).otherwise(F.lit(262_144))
    return found.select("*", (F.lit(padded) * F.col("width")).alias("embedding"), rate.alias("most_rate"), F.round(rate * 0.1, 7).alias("least_rate"), batch.alias("batch_tokens"), (F.col("params") * 20).alias("tokens"))


def learning_rates(width: Column) -> tuple[Column, Column]:
    """Largest and least learning rate by width, 6e-4 at 768."""
    most = F.lit(6e-4) * F.sqrt(F.lit(768.0) / width)
    return most, most * 0.1


def training_budget(params: Column, per_param: float = 50.0, length: int = 2048, batch: int = 64) -> dict[str, Column]:
    """tokens, steps and warmup of a run."""
    tokens = (params * F.lit(per_param)).cast("long")
    steps = F.greatest(F.lit(1), F.floor(tokens / (length * batch)))
    return {"tokens": tokens, "steps": steps, "warmup": F.least(F.lit(2000), F.greatest(F.lit(100), (steps * F.lit(0.03)).cast("long")))}


def cosine_rate(step: Column, warmup: int, total: int, most: float, least: float) -> Column:
    """Linear warm-up from 1 / warmup, then half a cosine, then the least rate."""
    part = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, F.lit(most) * (step + 1) / max(1, warmup)).when(step > total, F.lit(least)).otherwise(F.lit(least) + 0.5 * (1 + F.cos(F.lit(math.pi) * part)) * (most - least))


def cosine_factor(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """The factor of a schedule whose warm-up begins at 0."""
    part = F.least(F.greatest((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.lit(least) + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * part)))


def ladder_choice(estimate: Column, ladder: tuple[int, ...] = (256, 128, 64, 32, 16, 8, 4, 2, 1)) -> Column:
    """The first rung that isn't above the estimate, else the last."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, ladder)), lambda x: x <= estimate), F.lit(0)), F.lit(ladder[-1]))
