"""Exact deduplication by composable polynomial fingerprints (operator 5).

1. Texts are normalised ([\\x20\\x09-\\x0D]+ becomes one space) and fingerprinted: chunks of ``CHUNK`` bytes are hashed
   side by side as one matrix product, then combined by length-shifted arithmetic,
   ``h(xy) = h(x) * B^len(y) + h(y)`` modulo a prime, under two primes. A text over ``huge_bytes`` is first cut into
   segments that different tasks hash; their fingerprints combine by the same rule.
2. Rows with an equal fingerprint and length are grouped by a partial, then a final aggregation, so a group of any size
   sends one row a task.
3. Equal fingerprints are not believed: every member's text streams as chunk rows into a minimum and a maximum per
   (fingerprint, chunk number), again combined before the shuffle. Groups in which some chunk differs are a collision
   and are regrouped by the text itself.

Defined results: a null text is an empty one, and empty texts are copies of each other. Of equal texts exactly one row is
kept: the smallest doc_id's, null ones last, and one of the rows that repeat it. Rows with a null doc_id count in
group_size; if all of a group are null, so is its keep_id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BATCH_BYTES, bounded_batches, cut_lineage, docs_of, one_of_each, text_or_empty, written

CHUNK = 8192
#: Two primes under 2^31 with a base for each: byte * power summed over a chunk stays under 2^53, exact in a double.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525 * 613)
HUGE_BYTES = 64 << 20
SEGMENT_BYTES = 8 << 20
COMPARE_BYTES = 65536
SPACE_RUN = r"[\x20\x09-\x0D]+"


def _powers(n: int) -> np.ndarray:
    out = np.empty((n, len(PRIMES)), dtype=np.float64)
    for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for i in range(n - 1, -1, -1):
            out[i, k] = x
            x = x * b % p
    return out


_WEIGHTS = _powers(CHUNK)
_SHIFT = tuple(pow(b, CHUNK, p) for p, b in zip(PRIMES, BASES, strict=True))


def combined(left: tuple, right: tuple, shift: tuple) -> tuple:
    """The fingerprint of xy from those of x and y; shift is B^len(y) under each prime."""
    return tuple((a * s + b) % p for a, b, s, p in zip(left, right, shift, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple:
    """The polynomial hash of some bytes (each plus one) under each prime."""
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // CHUNK
    out = (0,) * len(PRIMES)
    for a in range(0, whole, 256):
        part = raw[a * CHUNK : min(a + 256, whole) * CHUNK].reshape(-1, CHUNK).astype(np.float64) + 1.0
        for row in (part @ _WEIGHTS).tolist():
            out = combined(out, tuple(int(x) for x in row), _SHIFT)
    rest = raw[whole * CHUNK :]
    if len(rest):
        last = (rest.astype(np.float64) + 1.0) @ _WEIGHTS[CHUNK - len(rest) :]
        out = combined(out, tuple(int(x) for x in last), tuple(pow(b, len(rest), p) for p, b in zip(PRIMES, BASES, strict=True)))
    return out


def normalised(text: str) -> bytes:
    """bytes.split() parts at exactly [\\x20\\x09-\\x0D]+; a run at either end stays as one space."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return data
    parts = data.split()
    if not parts:
        return b" "
    return b" " * data[:1].isspace() + b" ".join(parts) + b" " * data[-1:].isspace()


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, sizes, shas = [], [], []
        for text in batch.column("text"):
            data = normalised(text.as_py() or "")
            a, b = fingerprint(data)
            fp.append(a << 31 | b)
            sizes.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "fp", "n_bytes", "text_sha256"])


def _hash_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, doc, seg, data in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "seg", "part")), strict=True):
            a, b = fingerprint(data)
            rows.append({"key": key, "doc_id": doc, "seg": seg, "n": len(data), "a": a, "b": b} | {f"s{k}": pow(base, len(data), p) for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True))})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("key", "doc_id", "seg", "n", "a", "b", "s0", "s1")]))


def normalised_column(column: F.Column | None = None) -> F.Column:
    return F.regexp_replace(text_or_empty() if column is None else column, SPACE_RUN, " ")


def _cut(size: int, names: tuple[str, ...]):
    """Rows of the columns names, number and part: each normalised text in pieces of ``size`` bytes, cut in one walk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, part, held = [], [], [], 0
            for i, text in enumerate(batch.column("text")):
                data = normalised(text.as_py() or "")
                for k, a in enumerate(range(0, max(1, len(data)), size)):
                    row.append(i)
                    number.append(k)
                    part.append(data[a : a + size])
                    held += len(part[-1])
                    if held > BATCH_BYTES:
                        yield _pieces(batch, names, row, number, part)
                        row, number, part, held = [], [], [], 0
            yield _pieces(batch, names, row, number, part)

    return cut


def _pieces(batch: pa.RecordBatch, names: tuple[str, ...], row: list, number: list, part: list) -> pa.RecordBatch:
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in names], pa.array(number, pa.int64()), pa.array(part, pa.binary())], [*names, "number", "part"])


def fingerprints(docs: DataFrame, huge_bytes: int = HUGE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(doc_id, fp, n_bytes, text_sha256) of each row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs_of(docs, "doc_id", "text")
    long = F.octet_length(text_or_empty()) > huge_bytes
    usual = rows.where(~long).mapInArrow(_hash_batches, "doc_id long, fp long, n_bytes long, text_sha256 string")
    # A huge text: segments of the normalised text go to different tasks and combine in order.
    huge = rows.where(long).select("doc_id", "text", F.sha2(normalised_column(), 256).alias("sha"))
    parts = huge.withColumn("key", F.xxhash64("sha")).select("key", "doc_id", "text").mapInArrow(_cut(segment_bytes, ("key", "doc_id")), "key long, doc_id long, number long, part binary")
    hashed = parts.withColumnRenamed("number", "seg").repartition("key", "doc_id", "seg").mapInArrow(_hash_segments, "key long, doc_id long, seg long, n long, a long, b long, s0 long, s1 long")
    folded = hashed.distinct().groupBy("key", "doc_id").agg(F.sum("n").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("seg", "a", "b", "s0", "s1"))).alias("segs"))
    step = f"struct((acc.a * x.s0 + x.a) % {PRIMES[0]}L as a, (acc.b * x.s1 + x.b) % {PRIMES[1]}L as b)"
    whole = folded.select("key", "doc_id", "n_bytes", F.expr(f"aggregate(segs, struct(0L as a, 0L as b), (acc, x) -> {step}, acc -> shiftleft(acc.a, 31) | acc.b)").alias("fp"))
    shas = huge.select(F.xxhash64("sha").alias("key"), F.col("doc_id").alias("id"), F.col("sha").alias("text_sha256"))
    whole = shas.join(whole, (shas["key"] == whole["key"]) & shas["id"].eqNullSafe(whole["doc_id"])).select("doc_id", "fp", "n_bytes", "text_sha256")
    return usual.unionByName(whole)


def chunk_rows(docs: DataFrame, chunk_bytes: int = COMPARE_BYTES) -> DataFrame:
    """(fp, n_bytes, chunk, part) of the normalised texts, a row for each chunk."""
    return docs.select("fp", "n_bytes", "text").mapInArrow(_cut(chunk_bytes, ("fp", "n_bytes")), "fp long, n_bytes long, number long, part binary").withColumnRenamed("number", "chunk")


def exact_dedup(docs: DataFrame, huge_bytes: int = HUGE_BYTES, segment_bytes: int = SEGMENT_BYTES, fp_bits: int = 62) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    fp_bits below 62 weakens the fingerprint; tests use it to force collisions.
    """
    key = ["fp", "n_bytes"]
    rows = fingerprints(docs, huge_bytes, segment_bytes).withColumn("fp", F.col("fp").bitwiseAND((1 << fp_bits) - 1))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    # Groups only, written: Spark sees their size, broadcasts them or splits the rows of a group that very many texts are in.
    shared = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("text_sha256").alias("low"), F.max("text_sha256").alias("high")).where("n > 1"))
    members = rows.where("doc_id is not null").join(shared, key, "left_semi").select("doc_id", *key).distinct()
    texts = docs_of(docs, "doc_id", "text").join(members, "doc_id")
    chunks = chunk_rows(texts).groupBy(*key, "chunk").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    # Hardly ever any. A null doc_id has no texts to stream here; such rows are told apart by their digest.
    collided = written(chunks.where("low <> high").select(*key).unionByName(shared.where("low <> high").select(*key)).distinct())
    # A class is a fingerprint and length; in a collision the text's own digest too.
    classed = rows.join(collided.withColumn("split", F.lit(True)), key, "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = classed.groupBy(*key, "part").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups.select(*key, "part", F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row"), "n"))
    out = classed.join(groups, [*key, "part"], "left")
    alone = F.col("n").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def one_copy(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, whatever their ids: the smallest doc_id's; all columns stay."""
    return one_of_each(docs, lambda rows: exact_dedup(rows).select("doc_id", F.col("keep_id").alias("group_id")))
