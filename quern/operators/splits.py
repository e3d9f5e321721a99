"""Deterministic splits, budgets and mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.running import running_total


def hash_fraction(text: Column) -> Column:
    """A number in [0, 1) that depends on the text only: its SHA-256's first 32 bits modulo 100,000."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 100000 / F.lit(100000.0)


def hash_split(df: DataFrame, text: str = "text", val: float = 0.05, test: float = 0.05, out: str = "split") -> DataFrame:
    """Adds test, val or train; equal texts land together, whatever the partitioning."""
    u = hash_fraction(F.col(text))
    return df.withColumn(out, F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def split_totals(df: DataFrame, tokens: str, split: str = "split") -> DataFrame:
    """Documents, tokens, share in percent and MB (of two bytes a token) of each split."""
    g = df.groupBy(split).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).alias("tokens"))
    whole = F.sum("tokens").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return g.select(split, "docs", "tokens", (F.lit(100.0) * F.col("tokens") / F.greatest(whole, F.lit(1))).alias("share"), (F.col("tokens") * 2 / F.lit(1048576.0)).alias("mb"))


def char_split(text: Column, val: float = 0.1, test: float = 0.1) -> Column:
    """struct(train, val, test): a text cut at two places in proportion to its length."""
    n = F.length(text)
    a = (n * F.lit(1.0 - val - test)).cast("int")
    b = (n * F.lit(1.0 - test)).cast("int")
    return F.struct(F.substr(text, F.lit(1), a).alias("train"), F.substr(text, a + 1, b - a).alias("val"), F.substr(text, b + 1).alias("test"))


def first_passing(df: DataFrame, budget: int, order: list[str], bucket_rows: int = 1 << 16) -> DataFrame:
    """The first rows in order, at most budget; order begins with a number such as a position.

    Rows are numbered by totals of buckets, so a budget of any size is spread over tasks.
    """
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(one, "_one", order, F.floor(F.col(order[0]) / bucket_rows), "_nth").where(F.col("_nth") <= budget).drop("_one", "_nth")


def token_prefix(df: DataFrame, tokens: str, most: int, pos: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """Documents in order until the one that reaches ``most`` tokens, that one included; 0 is no limit."""
    if not most:
        return df
    placed = running_total(df, tokens, [pos], F.floor(F.col(pos) / bucket_rows), "_upto")
    return placed.where(F.col("_upto") - F.col(tokens) < most).drop("_upto")


def budget_counts(df: DataFrame, keep: Column, budget: int, pos: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """kept, skipped: rows that pass and rows that don't, up to the row in the order of pos whose passing fills the budget.

    A row passes where keep is true; null counts as false. The first passing row always counts, as with a budget of 1.
    """
    rows = df.select(F.col(pos), F.coalesce(keep, F.lit(False)).cast("long").alias("_keep"))
    placed = running_total(rows, "_keep", [pos], F.floor(F.col(pos) / bucket_rows), "_upto")
    read = placed.where(F.col("_upto") - F.col("_keep") < max(budget, 1))
    return read.agg(F.count_if(F.col("_keep") == 1).alias("kept"), F.count_if(F.col("_keep") == 0).alias("skipped"))


def shuffled_rank(df: DataFrame, key: str, seed: int = 42, out: str = "rank", buckets: int = 64, total: str | None = None) -> DataFrame:
    """Adds each row's place (0, 1, ..) in an order by a keyed hash: a shuffle that any partitioning repeats; total: all rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = df.withColumn("_h", h).withColumn("_one", F.lit(1).cast("long"))
    bucket = F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * F.lit(buckets) / 65536)
    ranked = running_total(rows, "_one", ["_h"], bucket, "_upto", total=total)
    return ranked.withColumn(out, F.col("_upto") - 1).drop("_h", "_one", "_upto")


def tail_split(df: DataFrame, key: str, least: int = 50, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds split: after a keyed shuffle the last max(least, ratio n) rows are val, all of them if there are fewer."""
    ranked = shuffled_rank(df, key, seed, "_rank", total="_rows")
    size = F.greatest(F.lit(least), F.floor(F.col("_rows") * F.lit(ratio)))
    return ranked.withColumn("split", F.when(F.col("_rank") >= F.col("_rows") - size, "val").otherwise("train")).drop("_rank", "_rows")


#: Shares of the instruction mix, the last takes the remainder.
PILLARS = (("code", 0.25), ("reasoning", 0.25), ("constraints", 0.20), ("dialogue", 0.15), ("synthetic", None))


def pillar_budgets(total: int) -> dict[str, int]:
    sizes = {name: int(total * share) for name, share in PILLARS if share is not None}
    return sizes | {name: total - sum(sizes.values()) for name, share in PILLARS if share is None}


def pillar_mix(pillars: dict[str, DataFrame], total: int, order: list[str]) -> DataFrame:
    """The first rows of each pillar up to its budget, as one bag with a column pillar."""
    out = None
    for name, budget in pillar_budgets(total).items():
        part = first_passing(pillars[name], budget, order).withColumn("pillar", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
