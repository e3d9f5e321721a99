import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import exact_dedup, graph, near_dup, suffix_dedup

DOCS = "doc_id long, text string"
AWKWARD = "doc_id long, text string, keep_id string, fp string, cls string, mark string, source string, component_id string, n long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], DOCS)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append(i)
    return {i: (min(groups[normalised(t)]), len(groups[normalised(t)]), hashlib.sha256(normalised(t).encode()).hexdigest()) for i, t in rows}


TEXTS = ["a b", "a  b", "a\tb", "a b ", " a b", "", None, " ", "\n\n", "é ü", "é  ü", "a b", "\x1ca b", "b a", "x" * 30000, "x" * 30000, "x" * 29999 + "y"]


@pytest.mark.parametrize(("huge", "segment", "bits"), [(1 << 26, 1 << 20, 62), (10, 7, 62), (10, 7, 2), (1 << 26, 1 << 20, 1)])
def test_exact_dedup(spark, huge, segment, bits):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_of(spark, TEXTS), huge, segment, bits).collect()}
    for i, (keep, size, sha) in exact_expected(rows).items():
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, size, keep == i, sha)


def test_exact_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a", "k", "f", "c", "m", "s", "x", 1), (3, "a", "k", "f", "c", "m", "s", "x", 1), (3, "a", "k", "f", "c", "m", "s", "x", 1), (None, "z", "k", "f", "c", "m", "s", "x", 1)], AWKWARD)
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == [("3", 3, 3, False), ("3", 3, 3, True), ("None", 3, 3, False), ("None", None, 1, True)]
    none = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b" * 9), (None, "c" * 9)], DOCS)
    for bits in (62, 0):
        got = sorted((r["group_size"], r["kept"], r["keep_id"]) for r in exact_dedup.exact_dedup(none, fp_bits=bits).collect())
        assert got == [(1, True, None), (1, True, None), (2, False, None), (2, True, None)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


@given(st.binary(max_size=40000), st.integers(0, 40000))
@settings(max_examples=50, deadline=None)
def test_fingerprints_compose(data, cut):
    left, right = data[:cut], data[cut:]
    shift = tuple(pow(b, len(right), p) for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True))
    assert exact_dedup.combined(exact_dedup.fingerprint(left), exact_dedup.fingerprint(right), shift) == exact_dedup.fingerprint(data)


def suffix_expected(texts, depth):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if n[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("depth", "gram", "seed"), [(16, 8, 1), (24, 6, 2), (9, 9, 3)])
def test_suffix_dedup(spark, depth, gram, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé ") for _ in range(60)) for _ in range(6)]
    piece = lambda: r.choice([r.choice(base)[r.randrange(30) :][: r.randrange(60)], "ab" * r.randrange(12), "".join(r.choice("abcdefg") for _ in range(20))])
    texts = ["".join(piece() for _ in range(r.randrange(8))) for _ in range(60)] + [None, "", "same text twice, long enough", "same text twice, long enough"]
    rows = suffix_dedup.suffix_dedup(docs_of(spark, texts), depth, gram).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows] == suffix_expected(texts, depth)


def test_suffix_dedup_at_the_contract_length(spark):
    """Passages of over 50 words that other documents have too go from 400 bytes on, and stay below that."""
    r = random.Random(11)
    prose = lambda n: "".join("".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8))) + " " for _ in range(n)).encode()
    cut = lambda n: prose(150)[:n].decode("utf-8", "ignore").ljust(n, "z")
    fill = lambda: prose(r.randrange(5, 90)).decode()
    under, just, over, twice = "".join(r.choice("abc ") for _ in range(399)), "".join(r.choice("abc ") for _ in range(400)), cut(900), "".join(r.choice("abc ") for _ in range(450))
    copy = fill() + cut(300)
    texts = ["1" + fill() + f"<{under}>" + fill(), "2" + fill() + f"({under})" + fill(), "3" + fill() + f"<{just}>" + fill(), "4" + fill() + f"({just})" + fill()]
    texts += [fill() + f"<{over}>", f"({over[300:]})" + fill(), f"({over[:610]})" + fill(), fill() + f"<{twice}>" + fill() + f"({twice})", copy, copy, None, ""]
    assert len(under.split()) > 50
    rows = suffix_dedup.suffix_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows] == suffix_expected(texts, 400)
    assert [x["n_removed"] for x in rows[:4]] == [0, 0, 400, 400]


def test_suffix_dedup_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 64)
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(3000))
    texts = [long, long[1000:1900], "x" * 500]
    rows = suffix_dedup.suffix_dedup(docs_of(spark, texts), 40, 16).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows] == suffix_expected(texts, 40)
    df = spark.createDataFrame([(None, "a" * 50, "k", "f", "c", "m", "s", "x", 1), (1, "b" + "a" * 30, "k", "f", "c", "m", "s", "x", 1), (1, "c" * 10, "k", "f", "c", "m", "s", "x", 1)], AWKWARD)
    got = sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"]) for x in suffix_dedup.suffix_dedup(df, 20, 8).collect())
    assert got == [("1", 10, 0), ("1", 31, 30), ("None", 50, 50)]
    twice = df.unionByName(df)
    assert sorted((x["n_bytes"], x["n_removed"]) for x in suffix_dedup.suffix_dedup(twice, 20, 8).collect()) == [(10, 0), (10, 0), (31, 31), (31, 31), (50, 50), (50, 50)]
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_passes_group_suffixes_by_their_first_bytes(spark):
    """After each pass, groups are those of the sampled suffixes in order, compared through the pass's depth."""
    r = random.Random(8)
    base = ["".join(r.choice("abcd") for _ in range(150)) for _ in range(5)]
    texts = ["".join(r.choice(base)[r.randrange(60) :][: r.randrange(30, 90)] for _ in range(5)) for _ in range(40)]
    depth, gram = 60, 12
    cuts = suffix_dedup.depths(depth, 30)
    regions, _ = suffix_dedup.sampled_suffixes(docs_of(spark, texts), depth, gram, 7)
    rows = {x["row"]: x["text"].encode() for x in suffix_dedup.rows_of(docs_of(spark, texts)).collect()}
    suffixes = regions.select("row", F.explode("edges").alias("edge"), *suffix_dedup.RANKS).dropDuplicates(["row", "edge"])
    live = {(x["row"], x["edge"]) for x in suffixes.collect()}
    said = lambda x, cut: rows[x[0]][x[1] : x[1] + cut]
    for cut, rank, kept in zip(cuts, suffix_dedup.RANKS, suffix_dedup.passes(suffixes, suffix_dedup.RANKS), strict=True):
        order = sorted(live, key=lambda x: said(x, cut))
        groups = {}
        for x in order:
            groups.setdefault(said(x, cut), set()).add(x)
        expected = {frozenset(g) for g in groups.values() if len(g) > 1}
        found = {}
        for x in kept.collect():
            found.setdefault(x[rank], set()).add((x["row"], x["edge"]))
        assert {frozenset(g) for g in found.values()} == expected
        live = {x for g in expected for x in g}
    assert live


def near_expected(texts):
    sets = []
    for t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "THE", "the"]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = [None, "", " ", "a", "A ", "a b c d", "a b c d e", "A  b\tc d e", "É b c d e"]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(3, 60))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 14)):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(r.choice([" ", "  ", "\n"]).join(words))
    return out


@pytest.mark.parametrize(("seed", "group", "hot"), [(1, 8, 1 << 19), (2, 2, 1 << 19), (3, 2, 20), (4, 3, 0)])
def test_near_dup(spark, monkeypatch, seed, group, hot):
    monkeypatch.setattr(near_dup, "GROUP", group)
    monkeypatch.setattr(near_dup, "MOST_HOT", hot)
    texts = near_texts(seed)
    rows = near_dup.near_dup(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == near_expected(texts)


def test_near_dup_edges(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, "k", "f", "c", "m", "s", "x", 1), (4, text, "k", "f", "c", "m", "s", "x", 1), (2, text + " ", "k", "f", "c", "m", "s", "x", 1), (2, text, "k", "f", "c", "m", "s", "x", 1), (9, None, "k", "f", "c", "m", "s", "x", 1), (None, "", "k", "f", "c", "m", "s", "x", 1)], AWKWARD)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_dup.near_dup(df).collect())
    assert got == [("2", 3, "2"), ("2", 3, "2"), ("4", 3, "2"), ("9", 0, "9"), ("None", 0, "None"), ("None", 3, "2")]
    assert near_dup.near_dup(df.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (4, text), (2, text), (2, text), (None, "x y"), (None, "x  y"), (7, None), (2, text + " eight nine"), (8, "z"), (8, "z")]
    df = spark.createDataFrame([(*x, "k", "f", "c", "m", "s", "x", 1) for x in rows], AWKWARD)
    said = lambda out: sorted((str(r["doc_id"]), " ".join((r["text"] or "").split())) for r in out.collect())
    kept = exact_dedup.one_copy(df)
    assert kept.columns == df.columns and said(kept) == [("2", text), ("2", text + " eight nine"), ("7", ""), ("8", "z"), ("None", "x y")]
    near = df.where("text not like '%nine'").unionByName(df.limit(1).withColumns({"text": F.lit(" " + text.upper()), "doc_id": F.lit(None).cast("long")}))
    kept = near_dup.one_near_copy(near)
    assert kept.columns == df.columns and said(kept) == [("2", text), ("8", "z"), ("None", "x y")]
    assert exact_dedup.one_copy(df.limit(0)).count() == 0 and near_dup.one_near_copy(df.limit(0)).count() == 0


def test_a_shingle_in_every_document(spark, monkeypatch):
    """The list of frequent shingles is full and one passage is in all texts; groups are those of brute force."""
    monkeypatch.setattr(near_dup, "GROUP", 3)
    r = random.Random(6)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for i in range(40):
        own = [f"d{i}x{j}" for j in range(r.randrange(2, 30))]
        texts += [" ".join([*own, *passage])] + [" ".join([*own[1:], *passage])] * (i % 3 == 0)
    for most in (1 << 19, 4):
        monkeypatch.setattr(near_dup, "MOST_HOT", most)
        rows = near_dup.near_dup(docs_of(spark, texts)).orderBy("doc_id").collect()
        assert [(x["n_shingles"], x["component_id"]) for x in rows] == near_expected(texts)


def test_opened_texts_come_in_slices(monkeypatch):
    import pyarrow as pa
    import zstandard

    from quern.llm import common

    monkeypatch.setattr(common, "BATCH_BYTES", 100)
    texts = [b"a" * 90, None, b"b" * 20, b"c" * 5000, b"", b"d"]
    frames = [None if t is None else zstandard.ZstdCompressor().compress(t) for t in texts]
    out = list(common.opened(iter([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(frames, pa.binary())], ["doc_id", "text"])])))
    assert [b.column("doc_id").to_pylist() for b in out] == [[0, 1], [2], [3], [4, 5]] and [t for b in out for t in b.column("text").to_pylist()] == texts


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_with_equal_polynomial_hashes(spark):
    """Thue-Morse words collide under any polynomial hash modulo 2^64; texts of them share no word."""
    import numpy as np

    from quern.llm import common, decontaminate

    morse = ["".join("xy"[(i.bit_count() + k) % 2] for i in range(2048)) for k in range(2)]
    texts = [" ".join([m] * 8) for m in morse]
    rows = near_dup.near_dup(docs_of(spark, [*texts, texts[0].upper()])).orderBy("doc_id").collect()
    assert [x["component_id"] for x in rows] == [0, 1, 0]
    items = spark.createDataFrame([(5, texts[0])], "item_id long, text string")
    assert {x["doc_id"]: x["contaminated"] for x in decontaminate.decontamination(docs_of(spark, texts), items).collect()} == {0: True, 1: False}
    some = ["", "a", "A", "b", "abcdefgh", "abcdefghi", "abcdefgh\0", "é", "x" * 64, "x" * 65, "X" * 65, *morse, "ab", "ba", "a" * 16, "a" * 8]
    data = common.LOWER[np.frombuffer("".join(some).encode(), np.uint8)]
    ends = np.cumsum([len(x.encode()) for x in some])
    h = common.word_hashes(data, np.r_[0, ends[:-1]], ends).tolist()
    assert len(set(h)) == len(some) - 2 and h[1] == h[2] and h[9] == h[10]


def test_copies_make_no_shingle_frequent(spark, monkeypatch):
    """Shingles are counted in one document of each class, whatever batches its copies lie in."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    texts = [" ".join(f"d{i}x{j}" for j in range(20)) for i in range(10)] * 12
    listed, find = [], near_dup._frequent_shingles
    monkeypatch.setattr(near_dup, "_frequent_shingles", lambda *x: listed.append(find(*x)) or listed[0])
    try:
        rows = near_dup.near_dup(docs_of(spark, texts)).orderBy("doc_id").collect()
    finally:
        spark.conf.set(key, before)
    assert [(x["n_shingles"], x["component_id"]) for x in rows] == near_expected(texts)
    assert not any(len(x[0]) for x in listed)


def test_only_texts_of_pairs_are_dealt_out(spark, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(3000)) for _ in range(60)]
    texts.append(texts[7] + " more")
    context, shuffled, links = spark._jsc.sc(), [], near_dup._links

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    def measured(*x):
        before = written()
        out = links(*x)
        shuffled.append(written() - before)
        return out

    monkeypatch.setattr(near_dup, "_links", measured)
    rows = near_dup.near_dup(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [x["component_id"] for x in rows] == [*range(60), 7]
    assert 0 < shuffled[0] < sum(map(len, texts)) / 5
