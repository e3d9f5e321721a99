"""Training windows over token streams kept as (doc, pos, token) chunks or arrays per shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliding_windows(streams: DataFrame, length: int, tokens: str = "tokens") -> DataFrame:
    """One row for each start: x of ``length`` tokens and y, the same one further; a stream of n tokens has n - length."""
    rows = streams.where(F.size(tokens) > length).withColumn("start", F.explode(F.sequence(F.lit(0), F.size(tokens) - length - 1)))
    return rows.withColumn("x", F.slice(tokens, F.col("start") + 1, length)).withColumn("y", F.slice(tokens, F.col("start") + 2, length)).drop(tokens)


def range_windows(ranges: DataFrame, length: int, step: int = 1) -> DataFrame:
    """path, start, x, y: the windows of whole shards from rows of readers.read_token_ranges(overlap=length) of them.

    A shard of n tokens has windows at 0, step, .. below n - length, wherever its rows are cut. With a step of batch * length
    these are the consecutive blocks of a loader.
    """
    skip = F.pmod(-F.col("first"), F.lit(step))
    last = F.least(F.col("own") - 1, F.size("tokens") - length - 1)
    rows = ranges.where(skip <= last).withColumn("at", F.explode(F.sequence(skip.cast("int"), last.cast("int"), F.lit(step))))
    return rows.select("path", (F.col("first") + F.col("at")).alias("start"), F.slice("tokens", F.col("at") + 1, length).alias("x"), F.slice("tokens", F.col("at") + 2, length).alias("y"))


def random_windows(streams: DataFrame, length: int, count: int, seed: int = 42, tokens: str = "tokens") -> DataFrame:
    """``count`` windows of each stream with starts drawn by a hash, below n - length - 1, with replacement."""
    rows = streams.where(F.size(tokens) > length + 1).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    rows = rows.withColumn("start", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in streams.columns if c != tokens], F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long") % (F.size(tokens) - length - 1)).cast("int"))
    return rows.withColumn("x", F.slice(tokens, F.col("start") + 1, length)).withColumn("y", F.slice(tokens, F.col("start") + 2, length)).drop(tokens)


def eval_chunks(streams: DataFrame, length: int, most: int | None = None, tokens: str = "tokens") -> DataFrame:
    """(n - 1) div length chunks without overlap, each with its targets, from the first ``most`` tokens."""
    rows = streams.withColumn(tokens, F.slice(tokens, 1, most)) if most else streams
    rows = rows.where(F.size(tokens) > length).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / length).cast("int") - 1)))
    return rows.withColumn("x", F.slice(tokens, F.col("chunk") * length + 1, length)).withColumn("y", F.slice(tokens, F.col("chunk") * length + 2, length)).drop(tokens)


def rank_blocks(streams: DataFrame, batch: int, length: int, world: int, tokens: str = "tokens") -> DataFrame:
    """block, rank, x and y of consecutive blocks of batch * length tokens, dealt to ranks in turn.

    Ranks are disjoint in every shard; a last block that lacks its target token is left out.
    """
    size = batch * length
    rows = tiled(streams, size + 1, tokens).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / size).cast("int") - 1)))
    part = F.slice(tokens, F.col("block") * size + 1, size + 1)
    grid = lambda first: F.transform(F.sequence(F.lit(0), F.lit(batch - 1)), lambda r: F.slice("_part", r * length + first, length))
    return rows.withColumn("_part", part).withColumn("rank", F.col("block") % world).withColumn("x", grid(1)).withColumn("y", grid(2)).drop(tokens, "_part")


def tiled(streams: DataFrame, least: int, tokens: str = "tokens") -> DataFrame:
    """A stream shorter than ``least`` is repeated from its start up to that length."""
    n = F.size(tokens)
    repeated = F.transform(F.sequence(F.lit(0), F.lit(least - 1)), lambda i: F.get(F.col(tokens), i % n))
    return streams.where(n > 0).withColumn(tokens, F.when(n >= least, F.col(tokens)).otherwise(repeated))


def document_spans(tokens: DataFrame, end: int, by: list[str]) -> DataFrame:
    """by, doc, first, n: the documents of a stream of (by, pos, token) rows, each up to its end mark."""
    marks = tokens.where(F.col("token") == end).select(*by, "pos")
    before = F.lag("pos").over(W.partitionBy(*by).orderBy("pos"))
    rows = marks.withColumn("first", F.coalesce(before + 1, F.lit(0)))
    return rows.withColumn("doc", F.row_number().over(W.partitionBy(*by).orderBy("pos")) - 1).select(*by, "doc", "first", (F.col("pos") - F.col("first") + 1).alias("n"))


def sampled_documents(drawn: DataFrame, end: int, prefix: int, truth: int, reach: int = 5000) -> DataFrame:
    """drawn (draw, path, size, offset, tokens: reach + prefix + truth of them) with outcome, prefix and truth.

    A document begins after the first end mark within reach of the offset. outcome accounts for every draw: found, no mark
    (within reach, in the same shard), too short (fewer than prefix + truth + 1 tokens are left in the shard), or mark in
    prefix; only a found one has prefix and truth.
    """
    at = F.array_position(F.slice("tokens", 1, reach), F.lit(end)).cast("int")
    head = F.slice("tokens", F.col("at") + 1, F.lit(prefix))
    left = F.col("size") - F.col("offset") - F.col("at")
    outcome = F.when(F.col("at") == 0, "no mark").when(left <= prefix + truth, "too short").when(F.array_contains(head, F.lit(end)), "mark in prefix").otherwise("found")
    rows = drawn.withColumn("at", at).withColumn("outcome", outcome)
    found = F.col("outcome") == "found"
    return rows.select("draw", "path", "offset", "outcome", F.when(found, head).alias("prefix"), F.when(found, F.slice("tokens", F.col("at") + 1 + prefix, F.lit(truth))).alias("truth"))
