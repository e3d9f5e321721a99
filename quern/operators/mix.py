"""Curriculum weights and the packing of weighted sources into token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quern.functions.running import running_total

#: Source, base ratio, tokens of its pool if that is finite, kind.
CURRICULUM = (
    ("FineWeb-Edu", 0.420, None, "open"),
    ("DCLM-Edu", 0.180, None, "open"),
    ("The-Stack-Filtered", 0.160, None, "open"),
    ("NuminaMath-CoT", 0.080, 220_000_000, "pool"),
    ("OpenMathReasoning", 0.060, 200_000_000, "pool"),
    ("SLM-Synthetic-Pretrain", 0.100, None, "anchor"),
)
#: Below so many parameters (last: any), the anchor's share and how often a pool is read.
TIERS = ((200_000_000, 0.11, 2.2), (600_000_001, 0.09, 3.0), (None, 0.05, 2.2))


def curriculum(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CURRICULUM)], "id int, source string, ratio double, pool long, kind string")


def curriculum_weights(sources: DataFrame, total: int, params: int) -> DataFrame:
    """id, source, weight: the anchor's share by model size, pools up to their caps, the rest over the open sources."""
    anchor, times = next((a, t) for most, a, t in TIERS if most is None or params < most)
    tokens = F.when(F.col("kind") == "anchor", (F.lit(total) * F.lit(anchor)).cast("long")).when(F.col("kind") == "pool", F.least((F.lit(total) * F.col("ratio")).cast("long"), (F.col("pool") * F.lit(times)).cast("long")))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sources.withColumn("tokens", tokens)
    rows = rows.withColumn("left", F.greatest(F.lit(total) - F.sum("tokens").over(every), F.lit(0))).withColumn("ratios", F.sum(F.when(F.col("kind") == "open", F.col("ratio"))).over(every))
    share = F.coalesce(F.col("tokens").cast("double"), F.col("ratio") / F.col("ratios") * F.col("left"))
    return rows.select("id", "source", (share / total).alias("weight"))


def curriculum_table(budgets: DataFrame) -> DataFrame:
    """total, params, source, weight of every row of budgets (total long, params long), as curriculum_weights gives them.

    The sources are few and fixed, so each row works out its own weights; there is no join and no shuffle.
    """
    tier = F.lit(None)
    for most, anchor, times in reversed(TIERS):
        both = F.struct(F.lit(anchor).alias("anchor"), F.lit(times).alias("times"))
        tier = both if most is None else F.when(F.col("params") < most, both).otherwise(tier)
    rows = budgets.select("total", "params", tier.alias("tier"))
    fixed = {}
    for name, ratio, pool, kind in CURRICULUM:
        if kind == "anchor":
            fixed[name] = (F.col("total") * F.col("tier.anchor")).cast("long")
        elif kind == "pool":
            fixed[name] = F.least((F.col("total") * F.lit(ratio)).cast("long"), (F.lit(pool) * F.col("tier.times")).cast("long"))
    rest = F.greatest(F.col("total") - sum(fixed.values()), F.lit(0))
    whole = sum(ratio for _, ratio, _, kind in CURRICULUM if kind == "open")
    share = lambda name, ratio: (fixed[name].cast("double") if name in fixed else F.lit(ratio / whole) * rest) / F.col("total")
    return rows.select("total", "params", F.inline(F.array(*[F.struct(F.lit(name).alias("source"), share(name, ratio).alias("weight")) for name, ratio, _, _ in CURRICULUM])))


def normalised_weights(sources: DataFrame, weight: str = "weight") -> DataFrame:
    return sources.withColumn(weight, F.col(weight) / F.sum(weight).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def weighted_order(docs: DataFrame, weights: DataFrame, budget: int, bucket_rows: int = 1 << 12, slots: int = 4096) -> DataFrame:
    """source, pos, epoch, n, start: the documents of a mix in a fair order and each one's first token in it.

    docs has source, pos (0, 1, .. in each source) and n (tokens, its end mark included). A document's turn is the tokens
    of its source before it, divided by the source's weight, so every source advances in proportion to its weight; a
    source that ends before its share of the budget starts over. Ties go to the source first by name. This is decided by
    running totals, two levels deep, so no task sees a whole source.
    """
    placed = running_total(docs, "n", ["pos"], F.floor(F.col("pos") / bucket_rows), "upto", ["source"])
    sizes = docs.groupBy("source").agg(F.sum("n").alias("size"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    plan = weights.join(sizes, "source").withColumn("share", F.col("weight") / F.sum("weight").over(every)).withColumn("epochs", F.ceil(F.col("share") * budget / F.col("size")).cast("int"))
    rows = placed.join(plan.select("source", "size", "share", "epochs"), "source").where("epochs > 0")
    rows = rows.select("source", "pos", "n", "upto", "size", "share", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    rows = rows.withColumn("turn", (F.col("epoch") * F.col("size") + F.col("upto") - F.col("n")) / F.col("share")).where(F.col("turn") < budget)
    bucket = F.floor(F.col("turn") * slots / budget)
    ordered = running_total(rows, "n", ["turn", "source", "pos"], bucket, "end")
    return ordered.select("source", "pos", F.col("epoch").cast("long").alias("epoch"), "n", (F.col("end") - F.col("n")).alias("start")).where(F.col("start") < budget)


def shard_pieces(order: DataFrame, shard_size: int, budget: int) -> DataFrame:
    """source, pos, epoch, shard, at, first, length: the part of a document in each shard that it reaches.

    at is the place in the shard, first the place in the document. Only the last shard may be shorter; nothing goes past
    the budget.
    """
    end = F.least(F.col("start") + F.col("n"), F.lit(budget))
    rows = order.withColumn("end", end).where("end > start")
    rows = rows.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / shard_size), F.floor((F.col("end") - 1) / shard_size))))
    base = F.col("shard") * shard_size
    begin = F.greatest(F.col("start"), base)
    return rows.select("source", "pos", "epoch", "shard", (begin - base).alias("at"), (begin - F.col("start")).alias("first"), (F.least(F.col("end"), base + shard_size) - begin).alias("length"))


def shard_tokens(pieces: DataFrame, docs: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """shard, at, tokens: the tokens of every piece, ready for a sink that writes a shard's pieces in order.

    ids is an array of numbers or a binary value of 16-bit tokens; pieces are in the same form.
    """
    joined = pieces.join(docs.select("source", "pos", ids), ["source", "pos"])
    first, length = F.col("first").cast("int"), F.col("length").cast("int")
    packed = isinstance(docs.schema[ids].dataType, BinaryType)
    part = F.col(ids).substr(2 * first + 1, 2 * length) if packed else F.slice(F.col(ids), first + 1, length)
    return joined.select(*keep, "shard", "at", part.alias("tokens"))


def validation_tokens(budget: int) -> int:
    """How much of a budget is set apart for validation."""
    return max(50_000, min(2_000_000, budget // 200))


def round_robin(docs: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Documents for validation: one of each source in turn until ``most`` tokens, the last included, by source id and pos."""
    rows = docs.join(sources.select("source", "id"), "source").where(F.col("pos") < most)
    return running_total(rows, "n", ["pos", "id"], F.floor(F.col("pos") / 256), "_upto").where(F.col("_upto") - F.col("n") < most).drop("_upto")


