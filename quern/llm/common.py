"""What several operators share: whole-column Arrow access, word and shingle hashes, checkpoints.

Everything here works on slices of an Arrow batch of at most ``SLICE_BYTES`` (a longer text is a slice of its own), so
memory in a Python worker is bounded by that and by the longest single text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

SLICE_BYTES = 512 << 10
#: Most bytes of an Arrow batch, unless the session sets its own bound.
BATCH_BYTES = 8 << 20
#: [\x20\x09-\x0D], the white space of every contract.
SPACES = (9, 10, 11, 12, 13, 32)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes with A-Z lower-cased.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
#: Bytes that aren't ASCII letters or digits nor part of another character.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


#: Paths of the tables that written() has made, by session.
_tables: dict[int, list[str]] = {}


def docs_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so columns that clash with an operator's own names never get near it."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES at most for Python workers, where the session doesn't say otherwise; JVM and worker hold several."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that the session names; only where none is set (tests) a folder of this machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and later readers take only the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.setdefault(id(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def squeezed(texts: DataFrame) -> DataFrame:
    """The column text as zstandard frames, before a shuffle of whole texts; opened() takes them out again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            frames = [None if t is None else tool.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield batch.set_column(at, "text", pa.array(frames, pa.binary()))

    return texts.mapInArrow(pack, StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType) for f in texts.schema.fields]))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose column text are the UTF-8 bytes that squeezed() packed, of BATCH_BYTES each or one longer text."""
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        frames = batch.column("text").to_pylist()
        ends = np.r_[0, np.cumsum([0 if t is None else zstandard.frame_content_size(t) for t in frames])]
        for a, b in slices(ends, BATCH_BYTES):
            texts = [None if t is None else tool.decompress(t) for t in frames[a:b]]
            yield batch.slice(a, b - a).set_column(at, "text", pa.array(texts, pa.large_binary()))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with one row of each group: the smallest doc_id, null ones last, and one of the rows that share it.

    grouped() gets the rows' texts with a key of each row as doc_id, and returns (doc_id, group_id) of all of them. The key
    is written along with the rows, so it stays the same for all who read it.
    """
    key = free_name(docs, "_row_key")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = grouped(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "group_id")
    groups = written(rows.select(key, F.col("doc_id").alias("_id")).join(groups, key))
    first = groups.groupBy("group_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", key)).alias("first"))
    gone = written(groups.select(key).join(first.select(F.col(f"first.{key}").alias(key)), key, "left_anti"))
    return rows.join(gone, key, "left_anti").drop(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder that the context was given; on one machine (tests) else one under the warehouse."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that written() has made for this session and that are still there."""
    return list(_tables.get(id(spark), []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that written() has made, once nothing reads them any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _tables[id(spark)].remove(path)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    column = column.fill_null("" if column.type == pa.large_string() else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with at most ``limit`` bytes each, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), _INVERSE if inverse else _BASE, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:
            _powers[inverse] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * B^j over j < i, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some stretches of bytes: eight bytes at a time through mixed(), all stretches side by side."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = end - start
    h = mixed(size.astype(np.uint64) * _BASE)
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        left = size[live] - at
        h[live] = mixed(h[live] * _BASE ^ eight[start[live] + at] & _FIRST_BYTES[np.minimum(left, 8)])
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of some texts in order, and the n + 1 offsets of the texts among them.

    Words end at the bytes marked in ``between`` and at the ends of a text.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return word_hashes(LOWER[data], start, end), np.searchsorted(start, offsets).astype(np.int64)


_STEP = mixed(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def step(i: int) -> np.uint64:
    """An odd multiplier for the i-th word of a shingle or seed."""
    return _STEP[i]


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every k-word shingle; a text of 1 to k - 1 words has its whole sequence as one."""
    n = len(at) - 1
    sizes = np.diff(at)
    doc = np.repeat(np.arange(n), sizes)
    if len(h) >= k:
        m = len(h) - k + 1
        s = np.zeros(m, np.uint64)
        for i in range(k):
            s += h[i : i + m] * _STEP[i]
        inside = doc[:m] == doc[k - 1 :]
        s, d = mixed(s[inside]), doc[:m][inside]
    else:
        s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        t = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = sizes[short] > i
            t[has] += h[at[short[has]] + i] * _STEP[i]
        s, d = np.concatenate([s, mixed(t + sizes[short].astype(np.uint64))]), np.concatenate([d, short])
    return s, d


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending by hash, and the n + 1 offsets of the texts among them."""
    n = len(offsets) - 1
    s, d = shingles(*words(data, offsets), k)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(n + 1)).astype(np.int64)
