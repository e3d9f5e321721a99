"""Benchmark decontamination by spaced-seed hashing (operator 8).

Words are runs of letters, marks and digits of Unicode, lower-cased (A-Z), so punctuation, case and spacing don't matter; in
scripts that set no spaces between words (``UNSPACED``) each character is a word.
Fixed masks look at some of the words at a position and ignore the others. Seeds (hashes of what a mask sees) of benchmark
and documents are joined as tables, and each pair is verified on its diagonal with the words around it. A document is
contaminated by an item if ``WINDOW`` consecutive words of it (all of it, where an item has fewer) agree with
``MOST_SUBSTITUTIONS`` exceptions at most, in whole documents and whole items. The masks hit every such pair of windows:
each choice of two exceptions among twelve words leaves some mask at some place untouched. An item of 6 to 11
words may differ in one, which leaves one of its halves whole; a shorter one is looked up as a whole and reported apart, since
a common phrase of one to five words doesn't make a document contaminated; only items without any word are left out.

1. The benchmark becomes a table of seeds, each with the ``REACH`` item words on either side of its first one.
2. A bitmap of the benchmark's seeds (at most ``1 << MOST_BITS`` bits; a fuller one lets more pass) goes along with the
   scan of documents, which emits a row for each of their seeds that is in it, with the words around it.
3. Both tables meet on the seed: Spark sees the benchmark's written size, and broadcasts it or splits common seeds. Pairs
   are verified in Arrow batches.

Defined results: a null text is an empty one; a null item text or id is left out. Rows of documents are independent;
in ``decontamination`` rows that repeat a doc_id share their findings, and so do rows with a null doc_id; ``clean_rows``
goes by the row. Extra columns are ignored; an empty
table of either kind gives no contamination.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, NOT_ALNUM, bounded_batches, buffers, docs_of, free_name, mixed, slices, step, word_hashes, words, written

WINDOW = 12
MOST_SUBSTITUTIONS = 2
#: Exceptions in an item of LEAST_JUDGED words or more that is shorter than a window.
SHORT_SUBSTITUTIONS = 1
LEAST_WORDS = 1
#: Items of fewer words are found and reported, but say nothing about a document: common phrases are like that too.
LEAST_JUDGED = 6
#: Positions that count; together they hit any 12 words of which any two differ.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5))
#: For items that are shorter than those, all of their words.
SHORT_MASKS = tuple(tuple(range(n)) for n in range(LEAST_WORDS, 6))
#: Code points of scripts without spaces (Thai, Lao, Myanmar, Khmer, New Tai Lue, Tai Tham, kana, Han, Javanese).
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: Words on either side of a seed's first one that its window can reach.
REACH = WINDOW - 1
LEAST_BITS, MOST_BITS = 22, 27
#: A seed sets the bits that it has from each of these places on.
PROBES = (0, 18, 36)
#: Stand for the places before and after an item, and before and after a document.
NO_ITEM, NO_TEXT = np.uint64(0), np.uint64(1)


@functools.cache
def _classes() -> np.ndarray:
    """0 between words, 1 part of a word, 2 a word of its own, by code point."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in UNSPACED:
        out[a : b + 1] *= 2
    return out


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, the offsets of the texts among them and the byte where each begins and the last ends.

    Broken bytes give some code point.
    """
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    c = padded[at]
    x, y, z = (padded[at + k] & 0x3F for k in (1, 2, 3))
    points = np.select([c < 0x80, c < 0xE0, c < 0xF0], [c, (c & 0x1F) << 6 | x, (c & 0xF) << 12 | x << 6 | y], (c & 7) << 18 | x << 12 | y << 6 | z)
    return np.minimum(points, 0x10FFFF), np.r_[0, np.cumsum(lead)][offsets], np.r_[at, len(data)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts in order, and the n + 1 offsets of the texts among them."""
    if not len(data) or data.max() < 128:
        return words(data, offsets, NOT_ALNUM)
    points, offsets, place = _code_points(data, offsets)
    kind = _classes()[points]
    first = kind > 0
    last = first.copy()
    joined = (kind[1:] == 1) & (kind[:-1] == 1)
    edges = offsets[1:-1]
    joined[edges[(edges > 0) & (edges < len(points))] - 1] = False
    first[1:] &= ~joined
    last[:-1] &= ~joined
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return word_hashes(LOWER[data], place[start], place[end]), np.searchsorted(start, offsets).astype(np.int64)


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash at each position at which the mask fits; masks differ in their hashes."""
    m = len(h) - mask[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(m, step(mask[-1] * 64 + len(mask)), np.uint64)
    for i, o in enumerate(mask):
        s += h[o : o + m] * step(i)
    return mixed(s)


def around(h: np.ndarray, off: np.ndarray, doc: np.ndarray, at: np.ndarray, empty: np.uint64) -> np.ndarray:
    """The words from REACH before to REACH after each place, one row each; ``empty`` beyond the ends of a text."""
    place = at[:, None] + np.arange(-REACH, REACH + 1)
    inside = (place >= off[doc][:, None]) & (place < off[doc + 1][:, None])
    out = np.full(place.shape, empty, np.uint64)
    out[inside] = np.maximum(h[place[inside]], np.uint64(2))
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(rows).view(np.int64).reshape(-1)), rows.shape[1]).cast(pa.list_(pa.int64()))


SEEDS = "item_id long, n long, seed long, words array<long>"


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of benchmark items, each with the item's number of words and those around the seed."""
    for batch in batches:
        data, bounds = buffers(batch.column("text"))
        for a, b in slices(bounds):
            h, off = tokens(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            size = np.diff(off)
            for mask in (*MASKS, *SHORT_MASKS):
                s, doc = seeds(h, mask), np.repeat(np.arange(b - a), size)
                at = np.arange(len(s))
                n = size[doc[at]]
                if mask in MASKS:
                    wanted = n >= 6
                else:
                    # All of an item of so many words, or either half of one that may differ in a word.
                    half = (n >= LEAST_JUDGED) & (n < WINDOW) & (n // 2 == len(mask)) & ((at == off[doc[at]]) | (at + len(mask) == off[doc[at] + 1]))
                    wanted = (n == len(mask)) | half
                at = at[wanted & (doc[at] == doc[at + mask[-1]])] if len(s) else at
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(a + doc[at])), pa.array(size[doc[at]]), pa.array(s[at].view(np.int64)), _lists(around(h, off, doc[at], at, NO_ITEM))], ["item_id", "n", "seed", "words"])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """SEEDS of the benchmark, written; a seed that an item has several times with the same words around it is one row."""
    items = docs_of(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    return written(items.mapInArrow(_seed_rows, SEEDS).distinct())


def bitmap(some: DataFrame) -> tuple[int, np.ndarray]:
    """The number of bits, and which of them the seeds set: 64 bits for each seed, and 1 << MOST_BITS of them at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * some.count()).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("seed", p).bitwiseAND((1 << bits) - 1) for p in PROBES]))
    held = some.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bit")).toArrow()
    out = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    out[held["word"].to_numpy()] = held["bit"].to_numpy()
    return bits, out


def _hit_rows(bits: int, present: np.ndarray, masks: list[tuple[int, ...]]):
    """The seeds of documents that are in the bitmap, with the words around them."""
    low = np.uint64((1 << bits) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(present.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            for a, b in slices(bounds):
                h, off = tokens(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                for mask in masks:
                    s = seeds(h, mask)
                    at = np.arange(len(s))
                    for p in PROBES:
                        at = at[table[(s[at] >> np.uint64(p) & low).astype(np.int64)]]
                    if not len(at):
                        continue
                    doc = np.searchsorted(off, at, "right") - 1
                    fits = at + mask[-1] < off[doc + 1]
                    at, doc = at[fits], doc[fits]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(a + doc)), pa.array(s[at].view(np.int64)), _lists(around(h, off, doc, at, NO_TEXT))], ["key", "seed", "around"])

    return rows


def agree(doc: np.ndarray, item: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For rows of words around a seed: whether some window agrees, or an item that is shorter than a window, all of it."""
    real = (item != NO_ITEM) & (doc != NO_TEXT)
    same = (doc == item) & real
    count = lambda x: np.pad(np.cumsum(x, 1), ((0, 0), (1, 0)))
    windows = lambda x: count(x)[:, WINDOW:] - count(x)[:, :-WINDOW]
    close = ((windows(real) == WINDOW) & (windows(same) >= WINDOW - MOST_SUBSTITUTIONS)).any(1)
    short = (real.sum(1) >= n) & (same.sum(1) >= n - np.where(n >= LEAST_JUDGED, SHORT_SUBSTITUTIONS, 0))
    return np.where(n >= WINDOW, close, short)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width = 2 * REACH + 1
        doc, item = (batch.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, width) for c in ("around", "words"))
        ok = agree(doc, item, batch.column("n").to_numpy())
        yield batch.select(["key", "item_id", "n"]).filter(pa.array(ok))


def row_overlaps(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, n) of rows (key long, text) and the items that they hold, once each; n: the item's words."""
    bounded_batches(rows.sparkSession)
    some = benchmark_seeds(benchmark)
    sizes = [r["n"] for r in some.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # 11 at most
    short = {n if n < LEAST_JUDGED else n // 2 for n in sizes}
    masks = [*MASKS, *(m for m in SHORT_MASKS if len(m) in short)]
    hits = rows.select("key", "text").mapInArrow(_hit_rows(*bitmap(some), masks), "key long, seed long, around array<long>")
    return hits.join(some, "seed").select("key", "item_id", "n", "around", "words").mapInArrow(_verified, "key long, item_id long, n long").distinct()


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ascending, comma-joined), n_short.

    n_short of the items have fewer than LEAST_JUDGED words; a document that holds no others isn't contaminated.
    """
    by = row_overlaps(docs_of(docs, "doc_id", "text").withColumnRenamed("doc_id", "key"), benchmark)
    by = by.groupBy("key", "item_id").agg(F.max("n").alias("n")).groupBy("key")
    by = written(by.agg(F.array_sort(F.collect_list("item_id")).alias("found"), F.count_if(F.col("n") < LEAST_JUDGED).alias("n_short"), F.max("n").alias("n")))
    rows = docs_of(docs, "doc_id").join(by, F.col("doc_id").eqNullSafe(F.col("key")), "left")
    found = F.coalesce("found", F.array().cast("array<long>"))
    judged = F.coalesce(F.col("n") >= LEAST_JUDGED, F.lit(False))
    return rows.select("doc_id", judged.alias("contaminated"), F.size(found).cast("long").alias("n_items"), F.array_join(found.cast("array<string>"), ",").alias("items"), F.coalesce("n_short", F.lit(0)).cast("long").alias("n_short"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text is contaminated, whatever their ids; all columns stay.

    Items of fewer than LEAST_JUDGED words are left out of this.
    """
    key = free_name(docs, "_row_key")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()))
    gone = written(row_overlaps(rows.select(F.col(key).alias("key"), "text"), benchmark).where(F.col("n") >= LEAST_JUDGED).select(F.col("key").alias(key)).distinct())
    return rows.join(gone, key, "left_anti").drop(key)
