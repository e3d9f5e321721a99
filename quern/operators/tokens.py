"""Pre-tokenising, byte tokens and encoding with a public vocabulary file. Vocabularies are read, never trained."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from quern.functions.shared import bounded_batches

#: The pre-tokenising pattern and the special tokens with their ids.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL_TOKENS = {
    "<|endoftext|>": 50256,
    "<|im_start|>": 50257,
    "<|im_end|>": 50258,
    "<|pad|>": 50259,
    "<s>": 50260,
    "</s>": 50261,
    "<|begin_of_text|>": 50262,
    "<think>": 50263,
    "</think>": 50264,
    "<tool_call>": 50265,
    "</tool_call>": 50266,
    "<tool_response>": 50267,
    "</tool_response>": 50268,
    "<|fim_prefix|>": 50269,
    "<|fim_middle|>": 50270,
    "<|fim_suffix|>": 50271,
    "<|fim_hole|>": 50272,
}
END_OF_TEXT, TURN_START, TURN_END, PAD = 50256, 50257, 50258, 50259


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PIECES), F.lit(0))


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """piece, n: how often each piece occurs in a table."""
    return df.select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """left, right, n: adjacent UTF-8 bytes inside pieces, weighted by the pieces' counts."""
    code = F.hex(F.encode("piece", "UTF-8"))
    rows = counts.select(code.alias("code"), "n").where(F.length("code") > 2)
    at = rows.select("code", "n", F.explode(F.expr("sequence(1, length(code) - 3, 2)")).alias("i"))
    pairs = at.select(F.expr("substring(code, i, 2)").alias("left"), F.expr("substring(code, i + 2, 2)").alias("right"), "n")
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n"))


def byte_count(text: Column) -> Column:
    """Tokens of a text under byte tokens and its end mark."""
    return (F.octet_length(text) + 1).cast("long")


def byte_values(text: Column) -> Column:
    """array<int>: the UTF-8 bytes of a text; null is an empty text. Time is linear: a byte of a binary value is found at once."""
    value = lambda raw, i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    # The binary value is bound once; each place is then looked up in it.
    every = F.transform(F.array(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), lambda raw: F.transform(_places(F.octet_length(raw)), lambda i: value(raw, i)))
    return F.get(every, F.lit(0))


def packed_bytes(text: Column) -> Column:
    """binary: the UTF-8 bytes of a text as 16-bit little-endian tokens, the form of a shard; null is an empty text.

    Latin-1 names each byte by a character of its own number, so whole texts are converted at once and not byte by byte.
    """
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return F.encode(F.decode(raw, "ISO-8859-1"), "UTF-16LE")


def byte_lookup(text: Column, table: Column) -> Column:
    """What a table of 256 entries, bound once, has for each byte of a text."""
    every = F.transform(F.array(F.struct(table.alias("table"), byte_values(text).alias("bytes"))), lambda s: F.transform(s["bytes"], lambda v: F.get(s["table"], v)))
    return F.get(every, F.lit(0))


def _places(n: Column) -> Column:
    """1 to n, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def byte_ids(text: Column) -> Column:
    """Base ids of a text's bytes: printable bytes come first, in the usual byte-level order; then the end mark."""
    return F.array_append(byte_lookup(text, F.array(*map(F.lit, _base_ids()))), F.lit(END_OF_TEXT))


def _base_ids() -> list[int]:
    """By byte value: its place among the printable bytes, or after them."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    place = {b: i for i, b in enumerate(printable + [b for b in range(256) if b not in set(printable)])}
    return [place[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def _encoder(path: str):
    import tiktoken

    made = _encoders.get(path)
    if made is None:
        made = _encoders[path] = tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=load_ranks(path), special_tokens=SPECIAL_TOKENS)
    return made


_encoders: dict = {}


#: Python holds the tokens of so many bytes at a time, or of one longer row.
SLICE_BYTES = 1 << 19


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of SLICE_BYTES of a column of texts or lists of numbers, or of one longer row."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def _with_column(df: DataFrame, read: str, out: str, kind: DataType, values: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with ``out`` made of the column ``read``, slice by slice, so that memory follows a slice and not a batch."""
    bounded_batches(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != out]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, read):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], values(part.column(read))], [*kept, out])

    return df.mapInArrow(run, StructType([*fields, StructField(out, kind)]))


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text, with special tokens recognised, and the end mark; the file is read once a worker."""

    def ids(texts: pa.Array) -> pa.Array:
        encoder = _encoder(vocabulary)
        lists = [np.append(encoder.encode_to_numpy(t or "", allowed_special="all").astype(np.int32), np.int32(END_OF_TEXT)) for t in texts.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)), pa.array(np.concatenate(lists)))

    return _with_column(df, text, out, ArrayType(IntegerType()), ids)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of ids; ids outside the vocabulary are skipped, broken UTF-8 is replaced."""

    def texts(lists: pa.Array) -> pa.Array:
        encoder = _encoder(vocabulary)
        known = encoder.n_vocab
        return pa.array([None if v is None else encoder.decode([i for i in v if i is not None and 0 <= i < known], errors="replace") for v in lists.to_pylist()], pa.string())

    return _with_column(df, ids, out, StringType(), texts)


def token_lengths(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds n, the number of tokens with the end mark, without keeping the ids."""

    def count(texts: pa.Array) -> pa.Array:
        encoder = _encoder(vocabulary)
        return pa.array([len(encoder.encode(t or "", allowed_special="all")) + 1 for t in texts.to_pylist()], pa.int64())

    return _with_column(df, text, "n", LongType(), count)


def special_spans(text: Column) -> Column:
    """A text cut at special tokens, longest first; the pieces are special tokens or have none."""
    quoted = "|".join(rf"\Q{t}\E" for t in sorted(SPECIAL_TOKENS, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?s){quoted}|.+?(?={quoted}|\z)"), F.lit(0))
