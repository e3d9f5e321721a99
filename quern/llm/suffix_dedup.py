"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 3).

Suffixes are ordered only through their first ``DEPTH`` bytes; those that stay together are exactly the repeated windows,
and every byte that such a window covers is removed. Passes take digits from the front of a suffix, most significant
first; a group after a pass is named by the digest of all its bytes so far (its rank), and a suffix that stands alone
drops out.

One row a byte would shuffle several times the text, so only a content-defined sample of the suffixes is sorted, and each
sampled suffix stands for up to ``BLOCK`` windows around it:

0. Sample. A window's anchor is its least hashed gram of ``GRAM`` bytes (the leftmost such): equal windows have equal
   anchors at equal places. Windows of one anchor are cut, by their distance to it, into blocks of ``BLOCK``; the sampled
   suffix of a block starts where its window nearest the anchor does. Anchors whose gram occurs once can't be repeated and
   are left out; texts that occur twice go whole, and one of them stands for its copies.
1. Passes 1 to ``PASSES`` order the sampled suffixes by successive pieces of the bytes that all windows of a block share.
2. The last pass orders, inside a group, the windows of each sampled suffix by the bytes that remain on either side.
   Equal neighbourhoods (regions) of a sampled suffix are one row with a count throughout; a region that occurs twice
   settles all its windows, so only groups with several regions take part.

Rows of a key are counted by partial and final aggregation, so a string that a third of all documents hold sends one row a
task and pass. Positions come back by a join on the region and are grouped by document.

Defined results: texts are UTF-8 bytes; null is empty. Windows don't cross documents. Each row is a document, whatever its
doc_id (null ones too), and rows that repeat both doc_id and text are copies of each other. Extra columns are ignored; an
empty table gives an empty result. Groups are named by 128-bit digests, which are seeded at random for each run.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SLICE_BYTES, bounded_batches, buffers, docs_of, mixed, opened, powers, prefix_hashes, slices, squeezed, text_or_empty, written

DEPTH = 400
GRAM = 64
BLOCK = 64
PASSES = 3
_PLACE = 22  # bits of a position inside a slice; SLICE_BYTES + DEPTH fits


def anchors(data: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of some bytes the place of its anchor, and the grams' hashes by place."""
    n = len(data) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_hashes(data)
    h = mixed((sums[gram:] - sums[:-gram]) * powers(len(data), inverse=True)[: len(data) - gram + 1])
    span = depth - gram + 1
    key = (h >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(h), dtype=np.uint64)
    # Least key of every span of places: least to the end of its stretch, least from the start of the next.
    rows = -(-len(key) // span)
    padded = np.full((rows + 1) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    padded = padded.reshape(-1, span)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(padded, axis=1).reshape(-1)
    least = np.minimum(after[:n], before[span - 1 : span - 1 + n])
    return (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64), h


def runs(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first and last window, anchor place and gram of each run of windows with one anchor, for a slice."""
    place, h = anchors(data, depth, gram)
    if not len(place):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    start = np.arange(len(place))
    doc = np.searchsorted(offsets, start, "right") - 1
    ok = start + depth <= offsets[doc + 1]
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(cut & ok)
    end = cut | ~ok
    ends = np.flatnonzero(end[1:] & ok[:-1]) if len(place) > 1 else np.zeros(0, np.int64)
    if ok[-1]:
        ends = np.r_[ends, len(place) - 1]
    return doc[first], first, ends, place[first], h[place[first]]


def _pieces(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, offsets and the place in the text of slices of a batch; long texts in overlapping pieces."""
    data, at = buffers(batch.column("text"))
    for a, b in slices(at):
        size = int(at[b] - at[a])
        if size <= SLICE_BYTES:
            yield a, data[at[a] : at[b]], at[a : b + 1] - at[a], 0
            continue
        for x in range(0, size - depth + 1, SLICE_BYTES):
            part = data[at[a] + x : min(at[a] + x + SLICE_BYTES + depth - 1, at[b])]
            yield a, part, np.array([0, len(part)]), x


def _anchor_rows(depth: int, gram: int):
    """row, body, grams, twice: the anchors of each text, each gram once, and which of them it has more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for a, data, off, _ in _pieces(batch, depth):
                doc, _, _, _, h = runs(data, off, depth, gram)
                at = np.searchsorted(doc, np.arange(len(off)))
                for d in range(len(off) - 1):
                    found[a + d].append(h[at[d] : at[d + 1]].view(np.int64))
            grams, twice = [], []
            for parts in found:
                g, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
                grams.append(g)
                twice.append(g[n > 1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("body"), pa.array(grams, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64()))], ["row", "body", "grams", "twice"])

    return rows


RANKS = [f"rank{i}" for i in range(1, PASSES + 1)]
REGIONS = "row binary, region binary, " + "".join(f"{r} binary, " for r in RANKS) + "low int, many int, left binary, right binary, edges array<int>, n long"


def depths(depth: int, block: int) -> list[int]:
    """How many bytes of a sampled suffix are ordered after each pass; the last is what all windows of a block share."""
    return [(depth - block + 1) * i // PASSES for i in range(1, PASSES + 1)]


def _region_rows(depth: int, gram: int, block: int, seed: int):
    """The blocks of windows whose anchor repeats; equal regions of a text are one row.

    edges: starts of the sampled suffixes, window k of a block starts at edge - k; rank1, rank2, ...: digests of the bytes
    that each pass has seen; low and many: the first k and the number of windows; left and right: the bytes of the region
    around those that all its windows share.
    """
    cuts = depths(depth, block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in opened(batches):
            ids = batch.column("row").to_pylist()
            wanted = batch.column("grams")
            out: dict[tuple[int, bytes], list] = {}
            for a, data, off, shift in _pieces(batch, depth):
                doc, first, last, place, h = runs(data, off, depth, gram)
                if not len(doc):
                    continue
                keep = np.zeros(len(doc), bool)
                lo = np.searchsorted(doc, np.arange(len(off)))
                for d in range(len(off) - 1):
                    if lo[d + 1] > lo[d]:
                        g = wanted[a + d].values.to_numpy(zero_copy_only=False).astype(np.int64)
                        keep[lo[d] : lo[d + 1]] = np.isin(h[lo[d] : lo[d + 1]], g.view(np.uint64))
                raw = data.tobytes()
                for d, x, y, p in zip(doc[keep].tolist(), first[keep].tolist(), last[keep].tolist(), place[keep].tolist(), strict=True):
                    base = int(off[d]) - shift
                    for b in range((p - y) // block, (p - x) // block + 1):
                        edge = p - b * block
                        wa, wb = max(x, edge - block + 1), min(y, edge)
                        stop = edge - block + 1 + depth
                        key = xxhash.xxh3_128_digest(raw[wa : wb + depth] + b"%d" % (edge - wb), seed)
                        if have := out.get((a + d, key)):
                            have[-1].append(edge - base)
                        else:
                            ranks = [xxhash.xxh3_128_digest(raw[edge : edge + c], seed) for c in cuts]
                            out[a + d, key] = [*ranks, edge - wb, wb - wa + 1, raw[wa:edge], raw[stop : wb + depth], [edge - base]]
                if len(out) > 50_000:
                    yield _region_batch(out, ids)
                    out = {}
            yield _region_batch(out, ids)

    return rows


def _region_batch(out: dict, ids: list) -> pa.RecordBatch:
    *ranks, low, many, left, right, edges = zip(*out.values(), strict=True) if out else ((),) * (PASSES + 5)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[r] for r, _ in out], pa.binary()),
            pa.array([k for _, k in out], pa.binary()),
            *[pa.array(r, pa.binary()) for r in ranks],
            pa.array(low, pa.int32()),
            pa.array(many, pa.int32()),
            pa.array(left, pa.binary()),
            pa.array(right, pa.binary()),
            pa.array(edges, pa.list_(pa.int32())),
            pa.array([min(2, len(e)) for e in edges], pa.int64()),
        ],
        ["row", "region", *RANKS, "low", "many", "left", "right", "edges", "n"],
    )


def _kept_rows(depth: int):
    """What is left of each text, given found array<struct<edges array<int>, mask long>>."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in opened(batches):
            total, removed, spans, shas, kept = [], [], [], [], []
            for text, found, whole in zip(batch.column("text"), batch.column("found"), batch.column("whole"), strict=True):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if found.is_valid and len(found.values):
                    edges = found.values.field("edges")
                    sizes = edges.value_lengths().to_numpy()
                    mask = np.repeat(found.values.field("mask").to_numpy(), sizes).view(np.uint64)
                    edge = edges.flatten().to_numpy().astype(np.int64)
                    for k in range(BLOCK):
                        at = edge[(mask >> np.uint64(k) & np.uint64(1)).astype(bool)] - k
                        np.add.at(change, at, 1)
                        np.add.at(change, at + depth, -1)
                gone = np.ones(len(data), bool) if whole.as_py() else np.cumsum(change)[:-1] > 0
                left = data[~gone].tobytes()
                total.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows


def rows_of(docs: DataFrame) -> DataFrame:
    """row, body, doc_id, text: body names the text, row the text and its doc_id, both by SHA-256."""
    rows = docs_of(docs, "doc_id", "text")
    body = F.sha2(text_or_empty(), 256)
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), body), 256)
    return rows.select(F.unhex(F.substring(row, 1, 32)).alias("row"), F.unhex(F.substring(body, 1, 32)).alias("body"), "doc_id", "text")


def passes(suffixes: DataFrame, ranks: list[str]) -> list[DataFrame]:
    """The suffixes left after each pass: those whose rank, the digest of the bytes seen so far, others have too."""
    out = []
    for rank in ranks:
        shared = suffixes.groupBy(rank).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(rank)
        suffixes = suffixes.join(shared, rank, "left_semi")
        out.append(suffixes)
    return out


def sampled_suffixes(docs: DataFrame, depth: int, gram: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of windows with repeated anchors (REGIONS), and (row) of the texts that occur twice."""
    texts = rows_of(docs).where(F.octet_length("text") >= depth).select("row", "body", "text")
    anchors_ = written(texts.mapInArrow(_anchor_rows(depth, gram), "row binary, body binary, grams array<long>, twice array<long>"))
    # A text that occurs twice goes whole; one of its documents stands for it below.
    copies = anchors_.groupBy("body").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    # Written: a table of measured size is broadcast, or Spark splits the rows of a body that very many texts have.
    several = written(copies.where("n > 1").select("body"))
    whole = anchors_.select("row", "body").join(several, "body", "left_semi").select("row").distinct()
    stands = anchors_.join(copies.select("row"), "row", "left_semi").dropDuplicates(["row"])
    grams = stands.select("row", F.explode("grams").alias("gram"), "twice").select("row", "gram", F.when(F.array_contains("twice", F.col("gram")), 2).otherwise(1).alias("n"))
    repeated = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    wanted = grams.select("row", "gram").join(repeated, "gram", "left_semi").groupBy("row").agg(F.collect_set("gram").alias("grams"))
    block = min(BLOCK, depth // 2)  # a block's windows must share some bytes
    found = squeezed(texts.select("row", "text")).join(wanted, "row").select("row", "text", "grams").mapInArrow(_region_rows(depth, gram, block, seed), REGIONS)
    return written(found), whole


def repeated_windows(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """row, whole, found: what repeats in each document, all of it or windows.

    found holds edges and 64-bit masks: bit k stands for the window that starts at edge - k.
    """
    block = min(BLOCK, depth // 2)
    regions, whole = sampled_suffixes(docs, depth, gram, secrets.randbits(63))
    same = [F.first(c).alias(c) for c in (*RANKS, "low", "many", "left", "right")]
    distinct = written(regions.groupBy("region").agg(*same, F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    settled = distinct.where("n > 1").select("region", F.expr("shiftleft(shiftrightunsigned(-1L, 64 - many), low)").alias("mask"))
    # A row for each distinct region: what is left after the passes has several regions in its group.
    left = written(passes(distinct.select("id", *RANKS), RANKS)[-1].select("id"))
    last = RANKS[-1]
    windows = distinct.join(left, "id", "left_semi").select("id", last, "left", "right", F.explode(F.expr("sequence(low, low + many - 1)")).alias("k"))
    rest = [F.col(last), F.col("k"), F.expr("substring(left, length(left) - k + 1, k)"), F.expr(f"substring(right, 1, {block - 1} - k)")]
    windows = windows.select((F.col("id") * BLOCK + F.col("k")).alias("place"), F.xxhash64(*rest).alias("h1"), F.xxhash64(F.lit(1), *rest).alias("h2"))
    equal = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    partial = windows.join(equal, ["h1", "h2"], "left_semi").groupBy(F.shiftright("place", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("mask"))
    partial = distinct.select("id", "region").join(partial, "id").select("region", "mask")
    verdict = settled.unionByName(partial).groupBy("region").agg(F.expr("bit_or(mask)").alias("mask"))
    parts = regions.select("row", "region", "edges").join(verdict, "region").select("row", F.struct("edges", "mask").alias("found"), F.lit(False).alias("whole"))
    # collect_list leaves nulls out.
    every = parts.unionByName(whole.select("row", F.lit(None).cast(parts.schema["found"].dataType).alias("found"), F.lit(True).alias("whole")))
    return every.groupBy("row").agg(F.max("whole").alias("whole"), F.collect_list("found").alias("found"))


def suffix_dedup(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    bounded_batches(docs.sparkSession)
    found = repeated_windows(docs, depth, gram)
    rows = squeezed(rows_of(docs).select("row", "doc_id", "text")).join(found, "row", "left").select("doc_id", "text", "whole", "found")
    return rows.mapInArrow(_kept_rows(depth), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
