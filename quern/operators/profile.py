"""Profiles of a corpus: families, tags, samples, markers, lengths, inventories, comparisons of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import first_truthy, lines, strip

#: Markers that are counted, keys that name a family, keys of tags.
MARKERS = ("<think>", "</think>", "<tool_call>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "def ", "class ", "assert ", "Problem:", "Solution:")
SIGNALS = ("signal", "family", "task", "type", "category")
TAGS = ("subtype", "difficulty", "domain", "topic")


def metadata(raw: Column) -> Column:
    """A JSON object as a map of strings; anything else is an empty map."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def family(meta: Column) -> Column:
    named = first_truthy(*[F.try_element_at(meta, F.lit(k)) for k in SIGNALS])
    return F.when(named == "", "unclassified").otherwise(named)


def family_stats(df: DataFrame, by: str, text: str = "text", pos: str | None = None) -> DataFrame:
    """Documents, share in percent, mean length and estimated tokens of each family, lengths without outer white space.

    With pos also first, the family's least position, and place: by number of documents, families seen first going first
    among those of equal size. Least positions are kept by the partial aggregation, so rows aren't sorted.
    """
    seen = [F.min(pos).alias("first")] if pos else []
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(strip(F.col(text)))).alias("chars"), *seen)
    whole = F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    place = [F.col("first"), F.row_number().over(W.orderBy(F.desc("n"), "first", by)).alias("place")] if pos else []
    return g.select(by, "n", (F.col("n") / whole * 100).alias("share"), (F.col("chars") / F.greatest("n", F.lit(1))).alias("mean_chars"), (F.col("chars") / F.lit(3.8)).cast("long").alias("tokens"), *place)


def family_tags(df: DataFrame, by: str, meta: str, pos: str | None = None) -> DataFrame:
    """by, tag, n: how often each 'key:value' of the tag keys occurs in a family; with pos also first, where it first does."""
    keep = F.map_filter(F.col(meta), lambda k, _: k.isin(*TAGS))
    rows = df.select(by, *([F.col(pos).alias("_pos")] if pos else []), F.explode(F.map_entries(keep)).alias("e"))
    seen = [F.min("_pos").alias("first")] if pos else []
    return rows.groupBy(by, F.concat("e.key", F.lit(":"), "e.value").alias("tag")).agg(F.count(F.lit(1)).alias("n"), *seen)


def family_samples(df: DataFrame, by: str, pos: str, most: int = 2) -> DataFrame:
    """The first rows of each family. A rank limit, so each task keeps only its own first rows before the shuffle."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(pos))).where(F.col("nth") <= most)


def first_rows(df: DataFrame, pos: str, most: int = 20) -> DataFrame:
    """The first rows by position: each task keeps its own first ones, so nothing is sorted as a whole."""
    return df.orderBy(pos).limit(most)


def marker_counts(df: DataFrame, text: str = "text", markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """marker, n: how many of the rows hold each marker, in the order of markers."""
    counts = df.agg(*[F.count_if(F.contains(F.col(text), F.lit(m))).alias(f"m{i}") for i, m in enumerate(markers)])
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"m{i}").alias("n")) for i, m in enumerate(markers)])
    return counts.select(F.inline(pairs))


def length_profile(df: DataFrame, text: str = "text") -> DataFrame:
    n = F.length(text)
    return df.agg(F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.avg(n).alias("mean"), (F.avg(n) / 4).cast("long").alias("tokens"))


def suffix_counts(paths: DataFrame, path: str = "path", suffixes: tuple[str, ...] = (".parquet", ".jsonl", ".jsonl.gz", ".bin")) -> DataFrame:
    """suffix, n of a list of files."""
    kinds = F.array(*map(F.lit, suffixes))
    return paths.select(F.explode(F.filter(kinds, lambda s: F.endswith(F.col(path), s))).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


def preview(text: Column, most: int = 25) -> Column:
    """struct(head, more): the first lines of a text and how many lines follow."""
    rows = lines(strip(text))
    return F.struct(F.array_join(F.slice(rows, 1, most), "\n").alias("head"), F.greatest(F.size(rows) - most, F.lit(0)).alias("more"))


def flattened(turns: Column) -> Column:
    """array<struct<from, value>> as lines 'from: value'."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["from"], F.lit(": "), t["value"])), "\n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def vector_difference(a: Column, b: Column) -> dict[str, Column]:
    """equal, largest and mean absolute difference, cosine and a verdict of two vectors."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    most = F.array_max(apart)
    cosine = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    verdict = F.when(most == 0, "identical").when((cosine > 0.999) & (most < 1e-4), "close").otherwise("different")
    return {"equal": most == 0, "max_diff": most, "mean_diff": F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x) / F.size(apart), "cosine": cosine, "verdict": verdict}
