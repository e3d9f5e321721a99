"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and components (operator 12).

A document's set is its distinct five-word shingles (``common.shingle_sets``). Two documents link when
``100 * both >= 85 * either``, a parameter.

1. Signatures. Every element of a set draws a random permutation of the ``slots`` and throws its j-th value, a number in
   [j, j + 1), at the j-th slot of it; a slot keeps its least value. So the slots of one element are correlated: they all
   differ, which gives signatures of a lower variance than independent hashes. Levels j are taken for all elements of many
   documents side by side, and a document stops at the level at which all of its slots are filled.
2. Documents with equal sets (128-bit digests) are one class, which goes on as one node.
3. Banding. Nodes that agree in all ``rows`` slots of one of ``bands`` bands meet in a bucket. At a similarity of 0.85 a
   pair misses all 40 bands of 5 slots with a probability of 7e-11.
4. Buckets of at most ``GROUP`` nodes give their pairs. A larger one gives a star around its most typical node, the one
   that meets most others in such buckets. Candidates are verified on full sets; links become components.
5. Large buckets that still lie in several components are not settled by their star. Their nodes, and only those, go
   through the prefix-filter join (``near_dup``) with the same threshold, which is exact and has no cap on a group.

Defined results: a null text is an empty one; a text without words has no set, links with nothing and is its own component.
component_id is the least doc_id that is not null; where all are null it is null. kept is whether doc_id equals it (null
equals null). Rows that repeat a doc_id are judged alike if their texts are equal. Extra columns are ignored; an empty
table gives an empty result. Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, buffers, cut_lineage, docs_of, mixed, opened, shingle_sets, slices, squeezed, text_or_empty, written
from quern.llm.graph import connected_components
from quern.llm.near_dup import near_dup, similar, verified

LEAST = (17, 20)
BANDS, ROWS = 40, 5
GROUP = 16
WORDS = 5
_LEVEL = np.uint64(56)  # the level stands above this bit of a slot's value
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _thrown(elements: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that elements throw at a level, and the places from which they take the next slot of their permutation."""
    r = mixed(elements + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64)))
    k = mixed(r + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
    return np.uint64(level) << _LEVEL | r >> np.uint64(8), level + (k * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)


def signatures(s: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """The SuperMinHash signature of each set of distinct hashes, one row each; an empty set's row is all ones."""
    if not 0 < slots < 256:
        raise ValueError("slots must be from 1 to 255")
    n = len(offsets) - 1
    out = np.full(n * slots, _NONE, np.uint64)
    base = np.repeat(np.arange(n) * slots, np.diff(offsets))
    value, slot = _thrown(s, 0, slots)
    np.minimum.at(out, base + slot, value)
    table = out.reshape(n, slots)

    def unfilled(base: np.ndarray, level: int) -> np.ndarray:
        """Which elements belong to documents with slots that a later level can still fill."""
        full = (table < np.uint64(level + 1) << _LEVEL).all(1) if level < 255 else np.ones(n, bool)
        return ~full[base // slots]

    keep = unfilled(base, 0)
    s, base, slot = s[keep], base[keep], slot[keep]
    # Each element's permutation, shuffled one place further at every level.
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(s), 1))
    rows = np.arange(len(s))
    order[rows, slot] = 0
    for level in range(1, slots):
        if not len(s):
            break
        value, place = _thrown(s, level, slots)
        slot = order[rows, place]
        order[rows, place] = order[rows, level]
        np.minimum.at(out, base + slot, value)
        keep = unfilled(base, level)
        if not keep.all():
            s, base, order = s[keep], base[keep], order[keep]
            rows = np.arange(len(s))
    return table


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = table[:, : bands * rows].reshape(len(table), bands, rows)
    h = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(table), 1))
    for i in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, i])
    return h


def _digests(s: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A name of each set; an empty one has none."""
    return [xxhash.xxh3_128_digest(s[a:b]) if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _signed(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for a, b in slices(at):
                s, off = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], WORDS)
                keys = band_keys(signatures(s, off, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(np.diff(off)), pa.array(_digests(s, off), pa.binary()), lists], ["doc_id", "body", "n", "cls", "keys"])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and set of squeezed texts."""
    for batch in opened(batches):
        data, at = buffers(batch.column("text"))
        for a, b in slices(at):
            s, off = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], WORDS)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(off * 8), pa.py_buffer(np.ascontiguousarray(s))])
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), raw.cast(pa.binary())], ["node", "set"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and text of squeezed texts."""
    for batch in opened(batches):
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text").cast(pa.large_string()).cast(pa.string())], ["node", "text"])


def _bodies(docs: DataFrame) -> DataFrame:
    """doc_id, text, body: the text's digest."""
    return docs_of(docs, "doc_id", "text").withColumn("body", F.unhex(F.substring(F.sha2(text_or_empty(), 256), 1, 32)))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and squeezed text of nodes (node, doc_id, body), one row each."""
    found = squeezed(_bodies(docs)).join(nodes.withColumnRenamed("doc_id", "_id"), ["body"]).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.dropDuplicates(["node"]).select("node", "text")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    if not pairs.take(1):
        return pairs
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_texts(docs, nodes.join(asked, "node", "left_semi").select("node", "doc_id", "body")).mapInArrow(_sets, "node long, set binary"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return cut_lineage(both.mapInArrow(verified(lambda x, y: similar(x, y, least)), "a long, b long"))


def candidates(shared: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) to verify of shared (key, node, n, members): all of a small bucket, a star of a large one."""
    num, den = least
    few, many = shared.where(F.col("members") <= GROUP), shared.where(F.col("members") > GROUP)
    x, y = (few.select("key", F.col("node").alias(v), F.col("n").alias(f"n_{v}")) for v in "ab")
    pairs = x.join(y, "key").where("a < b")
    # The centre of a bucket is the node that meets most others in large buckets.
    typical = many.groupBy("node").agg(F.sum("members").alias("meets"))
    centre = written(many.join(typical, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("c")).select("key", F.col("c.node").alias("c"), F.col("c.n").alias("n_c")))
    star = many.join(centre, "key").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"), F.col("n").alias("n_a"), F.col("n_c").alias("n_b"))
    fits = f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"
    return pairs.drop("key").unionByName(star).where(fits).select("a", "b").distinct()


def torn(shared: DataFrame, components: DataFrame) -> DataFrame:
    """The nodes of large buckets that lie in several components."""
    placed = cut_lineage(shared.where(F.col("members") > GROUP).select("key", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    keys = written(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
    return placed.join(keys, "key", "left_semi").select("node").distinct()


def minhash_near_dup(docs: DataFrame, least: tuple[int, int] = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; documents of a similarity of ``least`` or more link."""
    bounded_batches(docs.sparkSession)
    signed = _bodies(docs).mapInArrow(_signed(bands, rows), "doc_id long, body binary, n long, cls binary, keys array<long>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()))
    classes = written(signed.where("cls is not null").groupBy("cls").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")))
    one = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = one.select(F.col("row").alias("node"), "doc_id", "body")
    banded = one.select(F.col("row").alias("node"), "n", F.explode("keys").alias("key"))
    met = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(banded.join(met, "key"))

    links = _links(cut_lineage(candidates(shared, least)), docs, nodes, least)
    components = connected_components(links)
    rest = written(torn(shared, components))
    if rest.take(1):
        texts = written(_texts(docs, nodes.join(rest, "node", "left_semi")).mapInArrow(_plain, "node long, text string"))
        found = near_dup(texts.select(F.col("node").alias("doc_id"), F.col("text")), least=least)
        more = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        components = connected_components(links.unionByName(more))

    placed = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = written(placed.groupBy("component").agg(F.min("least_id").alias("component_id")))
    ids = placed.join(first, "component").select("cls", "component_id")
    out = signed.select("doc_id", "n", "cls").join(ids, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
