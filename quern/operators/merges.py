"""Byte-pair encoding as a table operation: merges are a table, distinct pieces are merged once, and their ids joined back.

A merge table (rank, left, right) is in order when each merge comes after those that make its two sides, as training gives
it. Merging the lowest-ranked pair from left to right until none is left is then one walk over all places where a merge
could apply, by rank, then place: a merge applies where both of its sides are whole tokens at that moment. These places
come from one join of the pieces' substrings with the merges; the walk is a fold inside the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from quern.functions.shared import bounded_batches, shared_folder
from quern.operators.tokens import SPECIAL_TOKENS, pieces, special_spans


def printable(text: Column) -> Column:
    """A text's bytes as characters of the byte-level alphabet, one each; null is an empty text."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    # Latin-1 names each byte by a character of its own number.
    raw = F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")
    return F.translate(raw, "".join(map(chr, hidden)), "".join(chr(256 + i) for i in range(len(hidden))))


def check_merges(merges: DataFrame) -> None:
    """Raises ValueError unless ranks and pairs are unique and each merge comes after those that make its sides."""
    made = merges.groupBy(F.concat("left", "right").alias("token")).agg(F.min("rank").alias("made"))
    sides = merges.select("rank", F.explode(F.array("left", "right")).alias("token"))
    if sides.join(made, "token").where("made >= rank").take(1):
        raise ValueError("a merge comes before one that makes its side")
    seen = merges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.count_distinct("left", "right").alias("pairs")).first()
    if seen["n"] != seen["ranks"] or seen["n"] != seen["pairs"]:
        raise ValueError("a rank or a pair occurs twice")


def merged_pieces(words: DataFrame, merges: DataFrame) -> DataFrame:
    """piece, tokens of words (piece): distinct pieces and their tokens in the byte-level alphabet.

    The merges, a vocabulary's own, go to every task: substrings of pieces are many more than pieces.
    """
    words = words.select("piece").distinct().select("piece", printable(F.col("piece")).alias("letters"), F.octet_length("piece").alias("size"))
    table = merges.select(F.concat("left", "right").alias("token"), F.length("left").alias("cut"), "rank")
    longest = table.agg(F.max(F.length("token"))).first()[0] or 1
    starts = words.select("piece", "letters", "size", F.explode(F.when(F.col("size") > 1, F.sequence(F.lit(0), F.col("size") - 2))).alias("i"))
    parts = starts.select("piece", "i", F.explode(F.sequence(F.col("i") + 2, F.least("size", F.col("i") + longest))).alias("j"), "letters")
    parts = parts.select("piece", "i", "j", F.substring("letters", F.col("i") + 1, F.col("j") - F.col("i")).alias("token"))
    places = parts.join(F.broadcast(table), "token").groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("rank", "i", (F.col("i") + F.col("cut")).alias("k"), "j"))).alias("places"))
    rows = words.join(places, "piece", "left")

    def walk(ends: Column, m: Column) -> Column:
        # ends: where the token that begins at each place ends, 0 if none begins there.
        fits = (F.get(ends, m["i"]) == m["k"]) & (F.get(ends, m["k"]) == m["j"])
        merged = F.concat(F.slice(ends, F.lit(1), m["i"]), F.array(m["j"]), F.slice(ends, m["i"] + 2, m["k"] - m["i"] - 1), F.array(F.lit(0)), F.slice(ends, m["k"] + 2, F.size(ends)))
        return F.when(fits, merged).otherwise(ends)

    single = F.sequence(F.lit(1), F.col("size"))
    rows = rows.where("size > 0").withColumn("ends", F.when(F.col("places").isNull(), single).otherwise(F.aggregate("places", single, walk)))
    spans = F.filter(F.transform("ends", lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda s: s["e"] > 0)
    return rows.select("piece", F.transform(spans, lambda s: F.substring(F.col("letters"), s["i"] + 1, s["e"] - s["i"])).alias("tokens"))


def piece_ids(words: DataFrame, merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """piece, ids of words (piece); vocabulary has token, id. A token without an id is left out."""
    # Outer, as Spark works out what an inner explode reads once more, to leave empty lists out.
    rows = merged_pieces(words, merges).select("piece", F.posexplode_outer("tokens").alias("at", "token")).join(F.broadcast(vocabulary.select("token", "id")), "token")
    return rows.groupBy("piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))


def text_pieces(text: Column) -> Column:
    """array<string>: the pieces of a text in order, null as empty. A special token is a piece of its own; no other piece equals one."""
    whole = F.coalesce(text, F.lit(""))
    may_have = reduce(or_, [F.contains(whole, F.lit(c)) for c in sorted({t[0] for t in SPECIAL_TOKENS})])
    spans = F.when(may_have, special_spans(whole)).otherwise(F.array(whole))
    return F.flatten(F.transform(spans, lambda s: F.when(s.isin(*SPECIAL_TOKENS), F.array(s)).otherwise(pieces(s))))


#: A chunk takes batches up to so many bytes of pieces, or one longer batch.
CHUNK_BYTES = 1 << 25


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts as chunks: each text's pieces as codes, and a row with the pieces that the codes stand for."""

    def chunk(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, names = uuid.uuid4().bytes, ["chunk", "key", "codes", "pieces"]
        key, lists = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("key", "pieces"))
        values = lists.flatten().dictionary_encode()
        codes = pa.ListArray.from_arrays(_offsets(lists), values.indices)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lists), pa.binary()), key, codes, pa.nulls(len(lists), pa.list_(pa.string()))], names)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.nulls(1, key.type), pa.nulls(1, codes.type), pa.ListArray.from_arrays([0, len(values.dictionary)], values.dictionary)], names)

    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > CHUNK_BYTES:
            yield from chunk(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from chunk(held)


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32))


def _decoded(known: pa.Table, coded: pa.Table) -> pa.Table:
    """key, ids of the texts of one chunk, given the ids of its codes."""
    ids = known.column("ids").combine_chunks().take(pa.array(np.argsort(known.column("code").to_numpy())))
    codes = coded.column("codes").combine_chunks()
    found = ids.take(codes.flatten())
    ends = _offsets(found).take(_offsets(codes))
    return pa.table({"key": coded.column("key"), "ids": pa.ListArray.from_arrays(ends, found.flatten())})


def encode_by_merges(texts: DataFrame, merges: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", end: int | None = None) -> DataFrame:
    """key, ids of all texts: special tokens found first, pieces merged once each, end (if given) last.

    Texts are written once as codes, in chunks of CHUNK_BYTES. A piece goes to the merged ones and back as one row a chunk,
    however often it occurs there, so no piece is a large group; a chunk's texts and codes then meet in one task. Texts that
    share a key are one text after the other, in no fixed order; a null key is one of its own.
    """
    check_merges(merges)
    spark = texts.sparkSession
    bounded_batches(spark)
    kind, path = texts.select(F.col(key).alias("key")).schema["key"].dataType, f"{shared_folder(spark)}/codes"
    rows = texts.select(F.col(key).alias("key"), text_pieces(F.col(text)).alias("pieces"))
    form = StructType().add("chunk", BinaryType()).add("key", kind).add("codes", ArrayType(IntegerType())).add("pieces", ArrayType(StringType()))
    rows.mapInArrow(_coded, form).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(form).parquet(path)
    used = stored.where("pieces IS NOT NULL").select("chunk", F.posexplode("pieces").alias("code", "piece"))
    known = piece_ids(used.select("piece").where(~F.col("piece").isin(*SPECIAL_TOKENS)), merges, vocabulary)
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_TOKENS.items() for x in pair])
    special = F.when(F.col("piece").isin(*SPECIAL_TOKENS), F.array(F.try_element_at(special, F.col("piece"))))
    ids = used.join(known, "piece", "left").select("chunk", "code", F.coalesce("ids", special, F.array().cast("array<int>")).alias("ids"))
    coded = spark.read.schema(form).parquet(path).where("codes IS NOT NULL").select("chunk", "key", "codes")
    found = ids.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_decoded, StructType().add("key", kind).add("ids", ArrayType(IntegerType())))
    # Ids are shuffled once more only where texts share a key.
    if stored.where("pieces IS NULL").groupBy("key").count().where("count > 1").take(1):
        found = found.groupBy("key").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return found.select(F.col("key").alias(key), (F.col("ids") if end is None else F.array_append("ids", F.lit(end))).alias("ids"))
