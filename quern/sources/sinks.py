"""Writers: token shards as 16-bit binary files through a Python data source, and JSON Lines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType

from quern.functions.running import running_total
from quern.operators.mix import shard_pieces, shard_tokens
from quern.sources.stores import store_of

#: Written last: the names and tokens of the shards that one job wrote.
MANIFEST = "_shards_{job}.json"


@dataclass
class _Wrote(WriterCommitMessage):
    shards: tuple[tuple[str, str, int], ...]


def shard_name(split: str, shard: int) -> str:
    """train_00000.bin; a split without numbers (shard -1) is train.bin."""
    return f"{split}.bin" if shard < 0 else f"{split}_{shard:05d}.bin"


def _packed(tokens: pa.Array) -> list[bytes]:
    """Lists of tokens as 16-bit values; binary values are packed already."""
    if not isinstance(tokens, pa.ListArray):
        return tokens.fill_null(b"").to_pylist()
    ids, ends = tokens.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())]
    if len(ids) and not 0 <= ids.min() <= ids.max() <= 0xFFFF:
        raise ValueError("a token needs more than 16 bits")
    packed = ids.astype("<u2")
    return [packed[a:b].tobytes() for a, b in pairwise(ends)]


class _ShardWriter(DataSourceArrowWriter):
    """Each task writes whole shards below _temporary/<job>/<task attempt>; the commit gives them their names.

    Attempts don't share a folder, so one that is retried, lost or run twice leaves nothing but its own temporary files, and
    those of the attempts that didn't count go with the job's folder. The manifest comes last: what it names is whole.
    """

    def __init__(self, folder: str, job: str, store: str | None) -> None:
        self.folder, self.job, self.named = folder.rstrip("/"), job, store

    @property
    def temporary(self) -> str:
        return f"{self.folder}/_temporary/{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Wrote:
        from pyspark import TaskContext

        store, task = store_of(self.folder, self.named), TaskContext.get().taskAttemptId()
        done: list[list] = []
        key, out = None, None
        for batch in batches:  # sorted by split, shard, at
            pieces = _packed(batch.column("tokens"))
            rows = zip(batch.column("split").to_pylist(), batch.column("shard").to_pylist(), batch.column("at").to_pylist(), strict=True)
            for i, (split, shard, at) in enumerate(rows):
                if (split, shard) != key:
                    if out:
                        out.close()
                    key = (split, shard)
                    name = shard_name(*key)
                    done.append([f"{self.temporary}/{task}/{name}", name, 0])
                    out = store.create(done[-1][0])
                if at != done[-1][2]:
                    raise ValueError(f"{name}: a piece begins at {at} where {done[-1][2]} tokens have been written")
                out.write(pieces[i])
                done[-1][2] += len(pieces[i]) // 2
        if out:
            out.close()
        return _Wrote(tuple(tuple(x) for x in done))

    def commit(self, messages: list) -> None:
        store = store_of(self.folder, self.named)
        shards = sorted((name, part, n) for m in messages if m for part, name, n in m.shards)
        if len({name for name, _, _ in shards}) < len(shards):
            raise ValueError("several tasks wrote the same shard")
        for name, part, _ in shards:
            store.rename(part, f"{self.folder}/{name}")
        with store.create(f"{self.folder}/{MANIFEST.format(job=self.job)}") as out:
            out.write(json.dumps([{"name": name, "tokens": n} for name, _, n in shards]).encode())
        store.delete_folder(self.temporary)

    def abort(self, messages: list) -> None:
        store_of(self.folder, self.named).delete_folder(self.temporary)


class TokenShards(DataSource):
    """Format "token_shards": rows (split, shard, at, tokens) become {split}_{shard}.bin in a folder of a store.

    tokens may also be binary, 16 bits each. Options: path, job (a name of its own for each job), store (see stores.py).
    """

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "split string, shard long, at long, tokens array<int>"

    def writer(self, schema, overwrite: bool) -> _ShardWriter:
        return _ShardWriter(self.options["path"], self.options["job"], self.options.get("store"))


def write_shards(pieces: DataFrame, folder: str, prefix: str = "train", partitions: int | None = None, store: str | None = None) -> None:
    """Writes the pieces of a shard in order into one file, all splits in one job.

    pieces has shard, at, tokens, and split, for which prefix stands where there is none. A task streams its shards and
    never holds one whole. Tokens need 16 bits at most, and a shard's pieces must follow each other without a gap; else the
    job fails and leaves no shard.
    """
    spark: SparkSession = pieces.sparkSession
    spark.dataSource.register(TokenShards)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.col("split") if "split" in pieces.columns else F.lit(prefix)
    rows = pieces.select(split.alias("split"), F.col("shard").cast("long").alias("shard"), F.col("at").cast("long").alias("at"), "tokens")
    writer = rows.repartition(n, "split", "shard").sortWithinPartitions("split", "shard", "at").write.format("token_shards")
    writer = writer.option("store", store) if store else writer
    writer.option("path", folder).option("job", uuid.uuid4().hex).mode("append").save()


def write_splits(df: DataFrame, folder: str, split: str, ids: str, pos: str, shard_size: int | None = 25_000_000, end: int | None = None, store: str | None = None) -> None:
    """Token documents in the order of pos as shards of each split, in one job.

    ids has lists of numbers or, which moves half the bytes, binary values of 16-bit tokens. end, if given, follows each document. shard_size None gives one file without a number for each split.
    """
    packed = isinstance(df.schema[ids].dataType, BinaryType)
    tokens, size = F.col(ids), (F.expr(f"octet_length(`{ids}`) div 2") if packed else F.size(ids)).cast("long")
    if end is not None:
        tokens = F.concat(tokens, F.lit(bytearray(end.to_bytes(2, "little")))) if packed else F.array_append(tokens, F.lit(end))
    rows = df.select(F.col(split).alias("source"), F.col(pos).alias("pos"), F.lit(0).alias("epoch"), tokens.alias("ids"), size.alias("n"))
    rows = rows.withColumn("n", F.col("n") + 1) if end is not None else rows
    placed = running_total(rows.drop("ids"), "n", ["pos"], F.floor(F.col("pos") / 4096), "end", ["source"]).withColumn("start", F.col("end") - F.col("n")).drop("end").where("n > 0")
    pieces = shard_tokens(shard_pieces(placed, shard_size or 1 << 62, 1 << 62), rows, keep=("source",))
    if shard_size is None:
        pieces = pieces.withColumn("shard", F.lit(-1))
    write_shards(pieces.withColumnRenamed("source", "split"), folder, store=store)


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8 JSON Lines; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_vocabulary(tokens: DataFrame, merges: DataFrame, specials: list[str], path: str) -> None:
    """(token, id) and (rank, left, right) as the JSON object that read_vocabulary reads, in a folder of any store.

    The format is one JSON object, so a vocabulary is one row; its size is that of a vocabulary, whatever the corpus.
    """
    by_id = F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda t: F.struct(t["token"], t["id"]))
    by_rank = F.transform(F.array_sort(F.collect_list(F.struct("rank", "left", "right"))), lambda m: F.concat_ws(" ", m["left"], m["right"]))
    encoder = tokens.agg(F.map_from_entries(by_id).alias("encoder"), F.lit(0).alias("_one"))
    both = encoder.join(merges.agg(by_rank.alias("merges"), F.lit(0).alias("_one")), "_one")
    special = F.array(*[F.lit(s) for s in specials]).cast("array<string>").alias("special_tokens")
    both.select(F.to_json(F.struct(special, "encoder", "merges"))).coalesce(1).write.mode("overwrite").text(path)
