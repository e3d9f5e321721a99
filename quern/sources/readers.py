"""Readers of corpora, dialogues, pairs, token shards and vocabularies. Paths may lie in any store that Spark reads."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.functions.running import running_total
from quern.functions.shared import shared_folder
from quern.functions.text import first_truthy, strip
from quern.operators.filters import code_quality, min_length, pick_text_column, rendered_reasoning
from quern.sources.ranges import TokenRanges
from quern.sources.stores import store_of

MESSAGES = "array<struct<role:string,content:string>>"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), length of all files; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select(F.regexp_replace(F.col("path"), rf"^.*?\Q{root.rstrip('/').split('://')[-1].lstrip('/')}\E/", "").alias("path"), "length")


def pick_files(files: DataFrame, prefix: str = "", part: str = "") -> DataFrame:
    """Parquet files, or JSON Lines files if there are none, whose path starts and contains so; sorted."""
    kept = files.where(F.startswith("path", F.lit(prefix.strip("/"))) & F.contains("path", F.lit(part)))
    kind = F.when(F.endswith("path", F.lit(".parquet")), 1).when(F.col("path").rlike(r"\.jsonl(\.gz)?$"), 2)
    known = kept.withColumn("kind", kind).where("kind is not null")
    first = known.agg(F.min("kind").alias("first"))
    return known.join(F.broadcast(first), F.col("kind") == F.col("first")).select("path", "length").orderBy("path")


def read_corpus(spark: SparkSession, paths: list[str], key: str | None = None, skip_bad_files: bool = False) -> DataFrame:
    """text of Parquet files: the named or first known text column, longer than 30 characters; only it is scanned."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_bad_files).lower()).parquet(*paths)
    return min_length(df.select(F.col(pick_text_column(df, key)).alias("text")))


def read_code(spark: SparkSession, paths: list[str], key: str = "content") -> DataFrame:
    """text of code files that pass the quality filter; the column must be there."""
    df = spark.read.parquet(*paths)
    return code_quality(df.select(F.col(pick_text_column(df, key, ())).alias("text")))


def read_reasoning(spark: SparkSession, paths: list[str], problem: str = "problem", solution: str = "solution", think: bool = False) -> DataFrame:
    """text made of a problem and its solution."""
    df = spark.read.parquet(*paths)
    p, s = (c if c in df.columns else d for c, d in ((problem, "problem"), (solution, "solution")))
    return df.select(rendered_reasoning(F.col(p), F.col(s), think).alias("text")).where("text is not null")


def read_jsonl(spark: SparkSession, paths: str | list[str], key: str = "text") -> DataFrame:
    """text of JSON Lines (plain or gzip), stripped; blank, broken and non-object lines and empty texts are left out."""
    value = strip(F.from_json(F.col("value"), "map<string,string>")[key])
    return spark.read.text(paths).select(value.alias("text")).where(F.coalesce(F.col("text"), F.lit("")) != "")


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """text of whole files."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """messages of .jsonl lines or a .json array, from the key messages or else conversations; another suffix is empty."""
    schema = f"messages {MESSAGES}, conversations {MESSAGES}"
    if not path.endswith((".jsonl", ".json")):
        return spark.createDataFrame([], f"messages {MESSAGES}")
    df = spark.read.schema(schema).option("multiLine", str(path.endswith(".json")).lower()).json(path)
    turns = F.when(F.size("messages") > 0, F.col("messages")).otherwise(F.col("conversations"))
    return df.select(turns.alias("messages")).where(F.size("messages") > 0)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """system, prompt, chosen, rejected of JSON Lines."""
    return spark.read.schema("system string, prompt string, chosen string, rejected string").json(path)


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """json: each line as it is, for records whose fields vary in shape."""
    return spark.read.text(path).withColumnRenamed("value", "json")


def token_files(spark: SparkSession, root: str, split: str) -> DataFrame:
    """path, length of a split's shards: {split}_*.bin, else {split}.bin. Validation never falls back to training data."""
    files = listing(spark, root)
    named = files.withColumn("kind", F.when(F.col("path").rlike(rf"(^|/){split}_[0-9]+\.bin$"), 1).when(F.col("path").rlike(rf"(^|/){split}\.bin$"), 2)).where("kind is not null")
    first = named.agg(F.min("kind").alias("first"))
    return named.join(F.broadcast(first), F.col("kind") == F.col("first")).select("path", "length").orderBy("path")


def shard_paths(spark: SparkSession, root: str, split: str) -> list[tuple[str, int]]:
    """Path and bytes of a split's shards, in order; one entry a file, as Spark itself lists them."""
    return [(f"{root.rstrip('/')}/{r['path']}", r["length"]) for r in token_files(spark, root, split).collect()]


def read_token_ranges(spark: SparkSession, shards: list[tuple[str, int]], overlap: int = 0, row_tokens: int = 1 << 16, task_tokens: int = 1 << 24, store: str | None = None) -> DataFrame:
    """path, size, first, own, tokens: token shards in rows of ``row_tokens`` tokens, with up to ``overlap`` that follow.

    Tasks read byte ranges, so a shard of any size is read by many of them, and many small ones by one; no row holds more than row_tokens + overlap.
    size is the shard's number of tokens, first the place of a row's first one, own how many are its own.
    """
    spark.dataSource.register(TokenRanges)
    rows = spark.read.format("token_ranges").option("files", json.dumps(shards)).option("overlap", overlap).option("rowTokens", row_tokens).option("taskTokens", task_tokens)
    rows = rows.option("tasks", spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.option("store", store) if store else rows).load()


def read_at(places: DataFrame, length: int, store: str | None = None) -> DataFrame:
    """places (path, size, offset and any others) with tokens, up to ``length`` of them from each offset of a shard on.

    Only these bytes are read, so the cost goes with the number of places, not with the size of the shards.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, offsets = (batch.column(c).to_pylist() for c in ("path", "size", "offset"))
            out: list = [None] * batch.num_rows
            for path, rows in groupby(sorted(range(batch.num_rows), key=lambda i: (paths[i], offsets[i])), key=paths.__getitem__):
                with store_of(path.rpartition("/")[0], store).open(path) as file:
                    for i in rows:
                        file.seek(2 * offsets[i])
                        out[i] = np.frombuffer(file.read(2 * min(length, sizes[i] - offsets[i])), "<u2").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "tokens"])

    return places.mapInArrow(fetch, StructType([*places.schema.fields, StructField("tokens", ArrayType(IntegerType()))]))


def drawn_places(spark: SparkSession, shards: list[tuple[str, int]], count: int, reserve: int, seed: int = 42) -> DataFrame:
    """draw, path, size, offset: ``count`` seeded positions, with replacement, in the concatenation of shards.

    The last ``reserve`` tokens of the whole aren't drawn. Positions meet the shards in cells as large as a shard is on
    average, so a shard has few cells and a cell few shards, and no draw is compared with all of them.
    """
    sizes = [(path, n // 2) for path, n in shards if n > 1]
    total = sum(n for _, n in sizes)
    if total <= reserve:
        return spark.createDataFrame([], "draw long, path string, size long, offset long")
    cell = -(-total // len(sizes))
    begins = [0, *accumulate(n for _, n in sizes)]
    files = spark.createDataFrame([(path, n, begin) for (path, n), begin in zip(sizes, begins, strict=False)], "path string, size long, begin long")
    files = files.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("begin") + F.col("size") - 1) / cell))))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % (total - reserve + 1)
    draws = spark.range(count).select(F.col("id").alias("draw"), place.alias("place")).withColumn("cell", F.floor(F.col("place") / cell))
    met = draws.join(files, "cell").where("place >= begin and place < begin + size")
    return met.select("draw", "path", "size", (F.col("place") - F.col("begin")).alias("offset"))


def _cut(batch: pa.RecordBatch, end: int) -> pa.RecordBatch:
    """path, pos, first, ends, whole, ids: the parts of rows of tokens between end marks; a row has one more than marks."""
    lists = batch.column("tokens")
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(size)]
    marks = np.flatnonzero(flat == end)
    at = np.searchsorted(starts, marks, "right") - 1 + np.arange(len(marks))  # the parts that end at marks
    n = np.bincount(at - np.arange(len(marks)), minlength=batch.num_rows)
    row = np.repeat(np.arange(batch.num_rows), n + 1)
    last = np.cumsum(n + 1) - 1
    k = np.arange(len(row)) - (last - n)[row]
    begin, stop = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    begin[last - n], stop[last] = starts[:-1], starts[1:]
    begin[at + 1], stop[at] = marks + 1, marks
    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(stop - begin)].astype(np.int32)), pa.array(flat[flat != end]))
    before, first = (batch.column(c).to_numpy()[row] for c in ("before", "first"))
    columns = [batch.column("path").take(pa.array(row)), pa.array(before + k), pa.array(first), pa.array(k < n[row]), pa.array((k > 0) & (k < n[row])), ids]
    return pa.RecordBatch.from_arrays(columns, ["path", "pos", "first", "ends", "whole", "ids"])


def range_documents(ranges: DataFrame, end: int) -> DataFrame:
    """path, pos, ids: the documents in ranges without overlap, each up to its end mark; what follows the last mark is left out.

    Rows meet the number of documents before them, then only documents that reach over the end of a row are shuffled; pos counts empty documents too, which aren't returned.
    """
    spark = ranges.sparkSession
    # Documents before each row, from a table of one short row for each row of tokens; it is written, so tokens are counted once.
    counts = f"{shared_folder(spark)}/marks"
    ranges.select("path", "first", F.size(F.filter("tokens", lambda t: t == end)).cast("long").alias("n")).write.parquet(counts)
    counted = spark.read.schema("path string, first long, n long").parquet(counts)
    before = running_total(counted, "n", ["first"], F.floor(F.col("first") / (1 << 26)), "upto", ["path"]).select("path", "first", "n", (F.col("upto") - F.col("n")).alias("before"))
    rows = ranges.select("path", "first", "tokens").join(before.select("path", "first", "before"), ["path", "first"])
    parts = rows.mapInArrow(lambda batches: map(partial(_cut, end=end), batches), "path string, pos long, first long, ends boolean, whole boolean, ids array<int>")
    inner = parts.where("whole").select("path", "pos", "ids")
    torn = parts.where("not whole").groupBy("path", "pos").agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("first", "ids"))).alias("p"))
    return inner.unionByName(torn.where("ends").select("path", "pos", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))).where(F.size("ids") > 0)


def read_token_documents(spark: SparkSession, shards: list[tuple[str, int]], end: int, store: str | None = None) -> DataFrame:
    """path, pos, ids of the documents in token shards, each without its end mark; what follows the last mark is left out."""
    return range_documents(read_token_ranges(spark, shards, store=store), end)


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(token, id) and (rank, left, right) of a vocabulary in JSON; a merge is cut at its first space."""
    raw = spark.read.text(path, wholetext=True).first()["value"]
    vocabulary = json.loads(raw)
    tokens = spark.createDataFrame(list(vocabulary["encoder"].items()), "token string, id int")
    merges = spark.createDataFrame([(i, *m.split(" ", 1)) for i, m in enumerate(vocabulary["merges"])], "rank int, left string, right string")
    return tokens, merges


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(token, id) and (rank, left, right) of a byte-level tokenizer file in JSON with model.vocab and model.merges."""
    model = json.loads(spark.read.text(path, wholetext=True).first()["value"])["model"]
    tokens = spark.createDataFrame(list(model["vocab"].items()), "token string, id int")
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    return tokens, spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "rank int, left string, right string")


def first_matching(df: DataFrame, language: str | None, pos: str) -> DataFrame:
    """The first row, or the first in a language; a top-1, not a sort."""
    kept = df.where(F.lower("lang") == language.lower()) if language else df
    return kept.orderBy(pos).limit(1)


def instruction_rows(df: DataFrame, prompts: tuple[str, ...], answers: tuple[str, ...]) -> DataFrame:
    """Adds prompt and answer: first truthy of the columns that are there, stripped; rows without either are dropped."""
    pick = lambda names: strip(first_truthy(*[F.col(n) for n in names if n in df.columns]))
    return df.withColumn("_p", pick(prompts)).withColumn("_a", pick(answers)).where("_p <> '' and _a <> ''").drop("prompt", "answer").withColumnsRenamed({"_p": "prompt", "_a": "answer"})
