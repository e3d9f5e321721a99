"""Near-duplicate groups by an n-gram Jaccard self-join with several global orders (operator 10).

A document's set is its distinct five-word shingles (see ``common.shingle_sets``), as 64-bit hashes. Documents with equal
sets are one class; classes, not documents, are joined. Two classes link at ``100 * both >= 75 * either`` (a parameter).

1. Frequencies. All distinct shingles of one document of each class are counted; the ``MOST_HOT`` most frequent of those in
   more than ``GROUP`` classes are listed: they go along with the later tasks, with a table of their levels by hash of at most
   ``1 << MOST_CELL_BITS`` bytes (a bounded list: it only decides the order, never the result).
2. First order: shingles outside that list by hash, then those in it from rare to frequent by level. If two sets are similar enough,
   the smaller one's indexing prefix and the larger one's probing prefix share a shingle under *any* order. Prefix entries
   are packed by bucket of the shingle's hash, one row for each task and bucket, and grouped by Spark; inside a bucket,
   groups of at most ``GROUP`` classes give their pairs.
3. Larger groups, and entries of listed shingles (which are dealt out evenly rather than by shingle), give a star around
   their most typical class first; only classes that still lie in different components afterwards, and that share enough
   listed shingles at best, are paired. So a group of copies of any size gives links in proportion to its size, and no
   pair that could change the result is skipped: a prefix with a listed shingle has all others of its set before it, so
   two classes that share one of those meet there, whether or not the list is full.
4. Candidates must share prefix shingles under two more orders too (hashes of the hashes), then are verified exactly. Their
   texts are dealt out compressed, those of other documents not at all: bitmaps of ids (``MOST_BITS`` at most; a fuller one
   lets more pass) go along with the tasks that read texts.
5. Links become components (``graph.connected_components``).

Defined results: a null text is an empty one; a text without words has no set, links with nothing and is its own
component. A null doc_id links only through rows of an equal set that have one, and gets their component_id; else null.
Rows that repeat a doc_id are judged alike if their texts are equal. Extra columns are ignored; an empty table gives an
empty result. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BATCH_BYTES, bounded_batches, buffers, cut_lineage, docs_of, mixed, one_of_each, shingle_sets, slices, written
from quern.llm.graph import connected_components

WORDS = 5
#: The threshold as a fraction, 75 / 100.
LEAST = (3, 4)
GROUP = 8
MOST_HOT = 1 << 22
#: The table of levels has at least so many cells for each listed shingle, and at most 1 << MOST_CELL_BITS.
CELLS = 4
MOST_CELL_BITS = 24
#: Levels for each doubling of a shingle's frequency.
LEVELS = 8
#: Buckets for each shuffle partition, and the shingles of all texts for each bucket: the larger number of buckets holds.
BUCKETS = 16
BUCKET_SHINGLES = 1 << 20
#: Bits of a bitmap for each of its ids, and of one bitmap.
ID_BITS = 16
MOST_BITS = 27
#: The two further orders sort by these remixes of the hashes.
ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def probing(n: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """n - ceil(t n) + 1"""
    num, den = least
    return n - -(-num * n // den) + 1


def indexing(n: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """n - ceil(2t / (1 + t) n) + 1"""
    num, den = least
    return n - -(-2 * num * n // (num + den)) + 1


def reduced(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high, low half of the hash in the low 32 bits; two shingles that meet here are told apart later."""
    return ((tokens >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (tokens & np.uint64(0xFFFFFFFF))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits set at the hashes of ids.doc_id."""
    bits = min(MOST_BITS, max(6, (ID_BITS * ids.count()).bit_length()))
    place = F.xxhash64("doc_id").bitwiseAND((1 << bits) - 1)
    held = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bit")).toArrow()
    out = np.zeros((1 << bits) >> 6, np.int64)
    out[held["word"].to_numpy()] = held["bit"].to_numpy()
    return out.view(np.uint64)


def _hashed(docs: DataFrame) -> DataFrame:
    """text, and its doc_id's hash as place; rows without a doc_id are left out."""
    return docs_of(docs, "doc_id", "text").where("doc_id is not null").select("text", F.xxhash64("doc_id").alias("place"))


def _among(present: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _hashed() whose doc_id is in a bitmap."""
    last = np.uint64(64 * len(present) - 1)
    for batch in batches:
        at = batch.column("place").to_numpy().view(np.uint64) & last
        yield batch.filter(pa.array((present[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a batch: first and last row, shingles and offsets."""
    data, at = buffers(batch.column("text"))
    for a, b in slices(at):
        yield a, b, *shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], WORDS)


def _class_of(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)], np.uint64).view(np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, s, off in _sets(batch):
            n.append(np.diff(off))
            c.append(_class_of(s, off))
        n, c = np.concatenate(n), np.concatenate(c)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(c, mask=n == 0)], ["doc_id", "n", "cls"])


def _packed(key: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each key, with each column's values as bytes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(key)] if len(key) else cut
    out = [pa.array(key[cut].astype(np.int64))]
    for x in columns.values():
        x = np.ascontiguousarray(x[order])
        out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.r_[cut, len(key)][: len(cut) + 1].astype(np.int64) * x.itemsize if len(cut) else np.zeros(1, np.int64)), pa.py_buffer(x)]).cast(pa.binary()))
    del ends
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def _new_rows(off: np.ndarray, classes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which texts of a slice have a class that this batch hasn't had yet."""
    fresh = np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        if off[i + 1] > off[i] and c not in seen:
            seen.add(c)
            fresh[i] = True
    return fresh


def _count_batches(buckets: int, present: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _among(present, batches):
            seen: set[int] = set()
            tokens = []
            for _, _, s, off in _sets(batch):
                fresh = _new_rows(off, _class_of(s, off), seen)
                tokens.append(reduced(s[np.repeat(fresh, np.diff(off))], buckets))
                if sum(map(len, tokens)) > 1 << 20:
                    yield _counted(tokens)
                    tokens = []
            yield _counted(tokens)

    return pack


def _counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of the shingles so far, by bucket: one that all texts share is one entry here."""
    t, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]), return_counts=True)
    # Most occur once: their counts take next to no space in a shuffle.
    return _packed(t >> np.uint64(32), {"tokens": t.astype(np.uint32), "counts": n.astype(np.uint32)})


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all rows of a packed column."""
    return np.concatenate([np.frombuffer(buffers(c)[0].tobytes(), kind) for c in column.chunks] or [np.zeros(0, kind)])


def _frequent(table: pa.Table) -> pa.Table:
    token, at = np.unique(_joined(table["tokens"], np.uint32), return_inverse=True)
    n = np.bincount(at, _joined(table["counts"], np.uint32), len(token)).astype(np.int64)
    hot = n > GROUP
    key = table["bucket"][0].as_py() << 32
    level = np.minimum(255, 1 + np.floor(LEVELS * np.log2(n[hot] / GROUP)))
    return pa.table({"token": pa.array(token[hot].astype(np.int64) | key), "level": pa.array(level.astype(np.int16))})


def _entry_batches(buckets: int, present: np.ndarray, hot: np.ndarray, levels: np.ndarray, least: tuple[int, int] = LEAST):
    """Prefix entries under the first order; hot: listed shingles ascending, levels: by their low bits, higher for frequent ones."""
    cell = np.uint64(len(levels) - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _among(present, batches):
            seen: set[int] = set()
            usual: list[tuple[np.ndarray, ...]] = []
            special: list[tuple[np.ndarray, ...]] = []
            for _, _, s, off in _sets(batch):
                classes = _class_of(s, off)
                fresh = _new_rows(off, classes, seen)
                n = np.diff(off)
                doc = np.repeat(np.arange(len(n)), n)
                keep = fresh[doc]
                s, doc = s[keep], doc[keep]
                t = reduced(s, buckets)
                late = levels[(t & cell).astype(np.int64)]
                maybe = np.flatnonzero(late)
                if len(maybe):
                    at = np.minimum(np.searchsorted(hot, t[maybe]), len(hot) - 1)
                    late[maybe[hot[at] != t[maybe]]] = 0
                    order = np.lexsort((s, late, doc))
                    t, late, doc = t[order], late[order], doc[order]
                first = np.searchsorted(doc, np.arange(len(n)))
                pos = np.arange(len(doc)) - first[doc]
                size = n[doc]
                quiet = np.bincount(doc[late == 0], minlength=len(n))[doc]
                probe = pos < probing(size, least)
                t, late, doc, pos, size, quiet = t[probe], late[probe], doc[probe], pos[probe], size[probe], quiet[probe]
                mark = size << 1 | (pos < indexing(size, least))
                listed = late > 0
                where = (t >> np.uint64(32)).astype(np.int64)
                usual.append((where[~listed], t[~listed].astype(np.uint32), classes[doc[~listed]], mark[~listed].astype(np.uint32)))
                # Entries of listed shingles are dealt out by class, past the buckets.
                where = buckets + (classes[doc[listed]].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                special.append((where, t[listed], classes[doc[listed]], mark[listed].astype(np.uint32), quiet[listed].astype(np.uint32)))
                if sum(len(p[0]) for p in usual + special) > 512 << 10:
                    yield from _entries(usual, special)
                    usual, special = [], []
            yield from _entries(usual, special)

    return pack


def _entries(usual: list, special: list) -> Iterator[pa.RecordBatch]:
    for parts, names in ((usual, ["tokens", "classes", "marks"]), (special, ["tokens", "classes", "marks", "quiets"])):
        if parts:
            where, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
            batch = _packed(where, dict(zip(names, columns, strict=True)))
            yield batch if "quiets" in names else batch.append_column("quiets", pa.array([b""] * batch.num_rows, pa.binary()))


#: Rows of the buckets: pairs (a, b), or with b null an entry of a class; typical: listed shingles of its whole set;
#: reach: shingles that it can share with a class it wasn't paired with in a bucket.
FOUND = "token long, a long, n_a long, index_a boolean, b long, typical long, reach long"


def _found(token, a, n, index, b=None, typical=None, reach=None) -> pa.Table:
    none = b is None
    fill = np.zeros(len(a), np.int64)
    return pa.table(
        {
            "token": pa.array(token.astype(np.uint64).view(np.int64)),
            "a": pa.array(a),
            "n_a": pa.array(n.astype(np.int64)),
            "index_a": pa.array(index),
            "b": pa.array(fill if none else b, mask=np.full(len(a), none)),
            "typical": pa.array(fill if typical is None else typical),
            "reach": pa.array(n.astype(np.int64) if reach is None else reach),
        }
    )


def _bucket_pairs(buckets: int, least: tuple[int, int] = LEAST):
    """Pairs (a, b) of small groups; b null: an entry of a larger group or a listed shingle.

    A class with a listed shingle in its prefix has all its others in it too. A partner that shares one of those is found in
    that one's group, small or large, and any other partner shares listed shingles only.
    """

    num, den = least

    def pairs(table: pa.Table) -> pa.Table:
        special = table["bucket"][0].as_py() >= buckets
        token, c, mark, quiet = (_joined(table[k], kind) for k, kind in (("tokens", np.uint64 if special else np.uint32), ("classes", np.int64), ("marks", np.uint32), ("quiets", np.uint32)))
        n, index = (mark >> 1).astype(np.int64), (mark & 1).astype(bool)
        if special:
            typical = n - quiet
            return _found(token, c, n, index, typical=typical, reach=typical)
        order = np.lexsort((c, n, token))  # inside a group by size, so a pair's first is the smaller one
        token, c, n, index = token[order], c[order], n[order], index[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
        token, c, n, index = token[new], c[new], n[new], index[new]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        of = np.repeat(size, size)
        large = of > GROUP
        left = np.repeat(start + size, size) - np.arange(len(token)) - 1  # members after this one
        a, b = [], []
        for step in range(1, GROUP):
            at = np.flatnonzero((left >= step) & ~large & index)
            at = at[n[at] * den >= num * n[at + step]]
            a.append(at)
            b.append(at + step)
        pair = np.unique(np.stack([c[np.concatenate(a)], c[np.concatenate(b)]], 1), axis=0)
        two = _found(np.zeros(len(pair), np.uint64), np.ascontiguousarray(pair[:, 0]), np.zeros(len(pair), np.int64), np.zeros(len(pair), bool), np.ascontiguousarray(pair[:, 1]))
        return pa.concat_tables([two, _found(token[large].astype(np.uint64) | np.uint64(table["bucket"][0].as_py() << 32), c[large], n[large], index[large])])

    return pairs


def _frames(present: np.ndarray):
    """Class and zstandard frame of the texts whose doc_id is in a bitmap."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in _among(present, batches):
            data, at = buffers(batch.column("text"))
            classes = [np.zeros(0, np.int64), *(_class_of(s, off) for _, _, s, off in _sets(batch))]
            frames = [tool.compress(data[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(classes)), pa.array(frames, pa.binary())], ["cls", "text"])

    return pack


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sets of distinct hashes share enough of what either has."""
    num, den = least
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def linked(x: np.ndarray, y: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sets of distinct hashes share prefixes under the further orders and are similar enough."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if least[1] * len(small) < least[0] * len(large):
        return False
    for salt in ORDERS:
        i, p = int(indexing(np.int64(len(small)), least)), int(probing(np.int64(len(large)), least))
        left, right = np.sort(mixed(small ^ salt))[:i], np.sort(mixed(large ^ salt))[:p]
        if not np.isin(left, right, assume_unique=True).any():
            return False
    return similar(x, y, least)


def verified(test: Callable[[np.ndarray, np.ndarray], bool]):
    """The pairs (a, b) whose sets set_a and set_b pass a test."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(v.as_py(), np.uint64) for v in batch.column(k)] for k in ("set_a", "set_b")]
            yield batch.select(["a", "b"]).filter(pa.array([test(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))

    return rows


def _checked(least: tuple[int, int]):
    """The pairs (a, b) whose sets, those of the frames text_a and text_b, are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b"))
            ends = np.r_[0, np.cumsum([zstandard.frame_content_size(p) + zstandard.frame_content_size(q) for p, q in zip(x, y, strict=True)], dtype=np.int64)]
            for i, j in slices(ends, BATCH_BYTES):
                frames = dict(zip([*a[i:j], *b[i:j]], [*x[i:j], *y[i:j]], strict=True))
                texts = pa.RecordBatch.from_arrays([pa.array([tool.decompress(f) for f in frames.values()], pa.large_binary())], ["text"])
                sets = dict(zip(frames, (s[p:q] for _, _, s, off in _sets(texts) for p, q in zip(off[:-1], off[1:], strict=True)), strict=True))
                yield batch.slice(i, j - i).select(["a", "b"]).filter(pa.array([linked(sets[p], sets[q], least) for p, q in zip(a[i:j], b[i:j], strict=True)], pa.bool_()))

    return rows


def _links(pairs: DataFrame, docs: DataFrame, ids: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = cut_lineage(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not pairs.take(1):
        return pairs
    asked = cut_lineage(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(ids, "cls"))
    # The text of one document of each class that is asked for; some others pass the bitmap.
    texts = _hashed(docs).mapInArrow(_frames(_bitmap(asked)), "cls long, text binary").dropDuplicates(["cls"]).join(asked.select("cls"), "cls", "left_semi")
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return cut_lineage(both.mapInArrow(_checked(least), "a long, b long"))


def _frequent_shingles(texts: DataFrame, present: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of more than GROUP classes, ascending, and their levels by low bits."""
    counts = written(texts.mapInArrow(_count_batches(buckets, present), "bucket long, tokens binary, counts binary").groupBy("bucket").applyInArrow(_frequent, "token long, level short"))
    least, held = 256, 0
    for level, n in sorted(((r["level"], r["n"]) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if held + n > MOST_HOT:
            break
        least, held = level, held + n
    out = np.zeros(1 << min(MOST_CELL_BITS, (CELLS * held).bit_length()), np.uint8)
    hot = counts.where(F.col("level") >= least).toArrow()
    token, level = hot["token"].to_numpy(), hot["level"].to_numpy()
    order = np.argsort(level, kind="stable")
    out[token[order] & (len(out) - 1)] = level[order]  # of a cell's levels the highest
    return np.sort(token.astype(np.uint64)), out


def _found_rows(texts: DataFrame, present: np.ndarray, buckets: int, least: tuple[int, int]) -> DataFrame:
    """Pairs of small groups and entries of large ones, as FOUND."""
    packed = texts.mapInArrow(_entry_batches(buckets, present, *_frequent_shingles(texts, present, buckets), least), "bucket long, tokens binary, classes binary, marks binary, quiets binary")
    return written(packed.groupBy("bucket").applyInArrow(_bucket_pairs(buckets, least), FOUND))


def near_dup(docs: DataFrame, group_buckets: int | None = None, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; documents of a similarity of ``least`` or more link."""
    num, den = least
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = cut_lineage(docs_of(docs, "doc_id", "text").mapInArrow(_summaries, "doc_id long, n long, cls long"))
    buckets = group_buckets or max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum("n")).first()[0] or 0) // BUCKET_SHINGLES)
    ids = rows.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    found = _found_rows(_hashed(docs), _bitmap(ids), buckets, least)
    large = found.where("b is null").select("token", F.col("a").alias("cls"), F.col("n_a").alias("n"), F.col("index_a").alias("indexed"), "typical", "reach", F.expr("typical > 0").alias("listed")).distinct()
    # The centre of a group is its most typical class, the one with the most listed shingles.
    # Written, here and below, so that a group's rows can be split over tasks where they meet its one row.
    star = written(large.groupBy("token").agg(F.max(F.struct("typical", "cls", "n")).alias("centre")))
    near = large.join(star, "token").where(f"cls <> centre.cls and {den} * least(n, centre.n) >= {num} * greatest(n, centre.n)").select(F.col("centre.cls").alias("a"), F.col("cls").alias("b"))
    links = _links(found.where("b is not null").select("a", "b").unionByName(near), docs, ids, least)
    first = connected_components(links)

    # Groups whose classes lie in several components: which components could still be linked, then their classes.
    placed = cut_lineage(large.join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    torn = written(placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"))
    # Written, so that a frequent shingle's rows are aggregated where they lie before they are dealt out again.
    open_ = written(placed.join(torn, "token", "left_semi"))
    sides = written(open_.groupBy("token", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.max("listed").alias("listed"), F.min(F.when(F.col("indexed"), F.col("n"))).alias("least_indexed")))
    x, y = sides.alias("x"), sides.alias("y")
    enough = f"{num + den} * least({{0}}.reach, {{1}}.reach) >= {num} * ({{0}}.{{2}} + {{1}}.{{2}})"
    apart = x.join(y, F.col("x.token") == F.col("y.token"))
    apart = apart.where("x.component <> y.component and x.least_indexed is not null").where(f"x.least_indexed <= y.most and {den} * x.most >= {num} * y.least and " + enough.format("x", "y", "least"))
    # What a class can share at a listed shingle says nothing about others, so the two kinds stay apart.
    apart = apart.select(F.col("x.component").alias("small"), F.col("y.component").alias("big"), F.col("x.listed").alias("kind")).distinct()
    members = open_.groupBy("component", "cls", "listed").agg(F.max("n").alias("n"), F.max("reach").alias("reach"), F.max("indexed").alias("indexed"))
    s, g = members.where("indexed").alias("s"), members.alias("g")
    across = apart.join(s, (F.col("small") == F.col("s.component")) & (F.col("kind") == F.col("s.listed"))).join(g, (F.col("big") == F.col("g.component")) & (F.col("kind") == F.col("g.listed")))
    across = across.where(f"s.n <= g.n and {den} * s.n >= {num} * g.n and " + enough.format("s", "g", "n")).select(F.col("s.cls").alias("a"), F.col("g.cls").alias("b"))
    more = _links(across, docs, ids, least)
    final = connected_components(links.unionByName(more)) if more.take(1) else first

    placed = rows.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = written(placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = placed.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_near_copy(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, whatever their ids: the smallest doc_id's; all columns stay."""
    return one_of_each(docs, lambda rows: near_dup(rows).select("doc_id", F.col("component_id").alias("group_id")))
