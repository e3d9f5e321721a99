"""Mixing sources to target weights (operator 6), in DataFrame functions only.

1. Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all sources;
   a target stops at ``most_epochs`` times its source's size and the excess is reshared by weight until none is above.
2. Each source's documents, in an order by hash of doc_id, are packed end to end and cut into blocks of ``block_words``; only the last
   block of a source is shorter. The running word count is taken in two levels (hash buckets, then documents inside a
   bucket), so a source with a third of all rows is spread over many tasks.
3. The output has as many slots as the targets take blocks, in shards of ``shard_slots``. Every slot draws its source from
   the targets' distribution with its own random number, and the draws of a shard are its counts of each source. The
   numbers of a shard are stratified (slot t of m draws from [t/m, (t+1)/m)), so a source's count in a shard misses its
   share by two at most, where plain multinomial draws would miss by the square root of the count. Nothing corrects the
   counts afterwards: what a source gives is what was drawn. ``shard_pieces`` puts a shard's slots in an order by hash.
4. Running counts over shards number the slots of a source. Slot k reads epoch k div n and block perm(k mod n) of its
   source's n blocks, where perm is an affine map of the indexes with a multiplier and an offset drawn from seed, source
   and epoch. Blocks are joined by index. A slot past ``most_epochs`` epochs has no block left and stays empty, so no
   document is read more often.

Defined results: a null text has no words and is never taken; a null source is a source of its own, after all others. A
null doc_id sorts first in its bucket; rows that repeat a doc_id are ordered by size and are as many documents. Extra columns are
ignored. If no document has a word all targets are 0.0. An empty table gives an empty result. Equal seeds give equal mixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.running import running_total
from quern.llm.common import cut_lineage

BLOCK_WORDS = 64
SHARD_SLOTS = 2048
#: Least number of buckets of a source; there are more where the table has over BUCKET_ROWS rows for each.
BUCKETS = 256
BUCKET_ROWS = 1 << 20
#: Shards that one bucket of the running counts holds.
SHARD_BUCKET = 1 << 12
#: Cells of [0, 1) by which draws meet the sources' ranges.
CELLS = 1 << 12
MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
#: Primes over 10^6; a multiplier is one that doesn't divide the number of blocks, so the map is a permutation.
PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)


def word_count(text: Column) -> Column:
    """Number of words: the pieces between runs of white space, without an empty first or last piece."""
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    edge = lambda p: text.rlike(p).cast("int")
    return F.coalesce(F.when(text == "", 0).otherwise(pieces - edge(r"^[\x20\x09-\x0D]") - edge(r"[\x20\x09-\x0D]\z")), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source (null stays null), size."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight, target: one row per source; the windows below run over this table of sources."""
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    rows = every.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(most_epochs)))
    # Water level: sources fill up in the order of most / weight; the level is that of the first source it doesn't fill, the highest of those.
    filled = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = F.sum("weight").over(filled.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("level", left / share).withColumn("open", F.col("level") <= F.col("most") / F.col("weight"))
    rows = rows.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(whole))
    return rows.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"), "rank")


def quotas(target: DataFrame, block_words: int = BLOCK_WORDS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds blocks, share (the blocks that the target takes), most (the slots that can be filled), and the range [lo, hi) of [0, 1)."""
    rows = target.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")).withColumn("most", F.col("blocks") * most_epochs)
    rows = rows.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    every, upto = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    some = F.when(F.col("share") > 0, F.col("rank"))
    rows = rows.withColumn("slots", F.ceil(F.sum("share").over(every)).cast("long"))
    rows = rows.withColumn("lo", F.coalesce(F.try_divide(F.sum("share").over(before), F.sum("share").over(every)), F.lit(0.0)))
    # The last source's range ends at 1 whatever the rounding.
    return rows.withColumn("hi", F.when(F.col("rank") == F.max(some).over(every), 1.0).otherwise(F.coalesce(F.try_divide(F.sum("share").over(upto), F.sum("share").over(every)), F.lit(0.0))))


def permuted(index: Column, epoch: Column, n: Column, source: Column, seed: int = SEED) -> Column:
    """The index that stands at a place of the source's permutation of 0 .. n - 1 in this epoch."""
    draw = lambda kind: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(kind), F.lit(seed), F.coalesce(source, F.lit("\u0000null")), epoch.cast("string"))), 1, 12), 16, 10).cast("long")
    able = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: n % p != 0)
    factor = F.element_at(able, (F.pmod(draw("a"), F.size(able)) + 1).cast("int"))
    return F.pmod(F.pmod(index, n) * factor + F.pmod(draw("b"), n), n)


def sorted_side(df: DataFrame) -> DataFrame:
    """Asks for a sort-merge join: exploded slots have estimates far under their size, which would broadcast them."""
    return df.hint("merge")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) drawn by MD5 from the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def drawn_slots(quota: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, slot, rank, k: every output slot with the source that it drew and its number among that source's slots."""
    spark = quota.sparkSession
    n = quota.agg(F.max("slots")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = spark.range(0, n, 1, parts).select(F.col("id").alias("slot"), F.expr(f"id div {shard_slots}").alias("shard"))
    m = F.least(F.lit(shard_slots).cast("long"), F.lit(n) - F.col("shard") * shard_slots)
    slots = slots.withColumn("u", (F.col("slot") % shard_slots + uniform(F.lit("slot"), F.lit(seed), F.col("slot"))) / m).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    # Each source's range as the cells that it touches.
    last = F.least(F.floor(F.col("hi") * CELLS).cast("int"), F.lit(CELLS - 1))
    ranges = quota.where("hi > lo").select("rank", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS).cast("int"), last), last)).alias("cell"))
    drawn = slots.join(sorted_side(ranges), "cell").where("u >= lo and u < hi").select("shard", "slot", "rank")
    counts = drawn.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("m"))
    counts = running_total(counts, "m", ["shard"], F.expr(f"shard div {SHARD_BUCKET}"), "upto", ["rank"]).select("rank", "shard", (F.col("upto") - F.col("m")).alias("before"))
    inside = W.partitionBy("rank", "shard").orderBy("slot")
    return drawn.join(sorted_side(counts), ["rank", "shard"]).select("shard", "slot", "rank", (F.col("before") + F.row_number().over(inside) - 1).alias("k"))


def slot_blocks(slots: DataFrame, quota: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, slot, rank, k, block: which block of its source each slot reads; null where all readings are used up."""
    rows = slots.join(sorted_side(quota.where("blocks > 0").select("source", "rank", "blocks", "most")), "rank")
    block = permuted(F.col("k") % F.col("blocks"), F.expr("k div blocks"), F.col("blocks"), F.col("source"), seed)
    return rows.select("shard", "slot", "rank", "k", F.when(F.col("k") < F.col("most"), block).alias("block"))


def shuffled_slots(slots: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The slots of each shard, which are drawn in the order of their sources, in an order by hash; a shard's are few."""
    mixed = W.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", F.lit("place"), F.lit(seed), F.col("slot").cast("string"))), "slot")
    return slots.withColumn("slot", F.col("shard") * shard_slots + F.row_number().over(mixed) - 1)


def packed(sizes: DataFrame, quota: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, rank, at: where each document starts among its source's words."""
    rows = sizes.join(quota.select(F.col("source").alias("_source"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    bucket = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % buckets, F.lit(0))
    rows = running_total(rows, "size", ["doc_id", "size"], bucket, "upto", ["rank"])
    return rows.select("doc_id", "source", "size", "source_size", "target", "rank", (F.col("upto") - F.col("size")).alias("at"))


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, rank, size, at, block, inside: the blocks over which each packed document lies, and its words in each."""
    spans = rows.where("size > 0").select("doc_id", "rank", "size", "at", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")).alias("block"))
    return spans.withColumn("inside", F.expr(f"least(at + size, (block + 1) * {block_words}) - greatest(at, block * {block_words})"))


def prepared(docs: DataFrame, block_words: int = BLOCK_WORDS, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The packed documents and the sources' quotas."""
    sizes = cut_lineage(measured(docs))
    quota = cut_lineage(quotas(targets(sizes), block_words))
    return packed(sizes, quota, max(buckets, sizes.count() // BUCKET_ROWS)), quota


def shard_pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """shard, slot, doc_id, first, n_words: the words of each document that each slot of the output holds."""
    rows, quota = prepared(docs, block_words, buckets)
    reads = shuffled_slots(slot_blocks(drawn_slots(quota, shard_slots, seed), quota, seed), shard_slots, seed).where("block is not null")
    held = pieces(rows, block_words).join(sorted_side(reads), ["rank", "block"])
    return held.select("shard", "slot", "doc_id", F.expr(f"greatest(0, block * {block_words} - at)").alias("first"), F.col("inside").alias("n_words"))


def source_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of each document."""
    rows, quota = prepared(docs, block_words, buckets)
    reads = slot_blocks(drawn_slots(quota, shard_slots, seed), quota, seed).where("block is not null")
    reads = reads.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    took = pieces(rows, block_words).join(sorted_side(reads), ["rank", "block"]).groupBy("doc_id", "rank", "size", "at").agg(F.sum(F.col("inside") * F.col("times")).alias("taken"))
    out = rows.alias("d").join(sorted_side(took).alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.rank") == F.col("t.rank")) & (F.col("d.at") == F.col("t.at")) & (F.col("d.size") == F.col("t.size")), "left")
    return out.select("d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
