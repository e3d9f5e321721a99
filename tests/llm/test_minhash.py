import random
import re

import numpy as np
import pytest

from quern.llm import minhash
from quern.llm.common import mixed

DOCS = "doc_id long, text string"
CLASHING = "doc_id long, text string, node string, cls string, key string, n long, a long, members long, component string, body string, row long"


def sets_of(texts):
    out = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def expected(texts, num=85, den=100):
    sets = sets_of(texts)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def plain_signature(elements, slots):
    """Element by element with early stopping, as the algorithm is written down."""
    best = [None] * slots
    for e in elements:
        order = list(range(slots))
        for j in range(slots):
            if all(v is not None and v >> 56 < j for v in best):
                break
            value, k = (int(x[0]) for x in minhash._thrown(np.array([e], np.uint64), j, slots))
            order[j], order[k] = order[k], order[j]
            if best[order[j]] is None or value < best[order[j]]:
                best[order[j]] = value
    return best


@pytest.mark.parametrize("slots", [1, 7, 200])
def test_signatures_are_those_of_the_plain_algorithm(slots):
    r = np.random.default_rng(2)
    sizes = [0, 1, 2, 5, 40, 0, 300, 1200, 1]
    s = r.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    off = np.r_[0, np.cumsum(sizes)]
    got = minhash.signatures(s, off, slots)
    for i, n in enumerate(sizes):
        assert got[i].tolist() == (plain_signature(s[off[i] : off[i + 1]], slots) if n else [2**64 - 1] * slots)
    with pytest.raises(ValueError, match="slots"):
        minhash.signatures(s, off, 256)


def test_signatures_estimate_similarity_with_less_spread():
    r = np.random.default_rng(3)
    for n, both in ((30, 28), (200, 150)):
        said = []
        for _ in range(150):
            u = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            x, y = minhash.signatures(np.r_[u[:n], u[n - both :]], np.array([0, n, 2 * n]), 200)
            said.append((x == y).mean())
        true = both / (2 * n - both)
        assert abs(np.mean(said) - true) < 0.01 and np.std(said) < 0.95 * (true * (1 - true) / 200) ** 0.5


def texts_of(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "THE", "the"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = [None, "", " ", "a", "A ", "a b c d", "a b c d e", "A  b\tc d e", "É b c d e"]
    for _ in range(9):
        base = [r.choice(vocabulary) for _ in range(r.randrange(3, 150))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 25)):
            words = list(base)
            for _ in range(r.randrange(5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(r.choice([" ", "  ", "\n"]).join(words))
    return out


@pytest.mark.parametrize(("seed", "group"), [(1, 16), (2, 2), (5, 4)])
def test_minhash_near_dup(spark, monkeypatch, seed, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    texts = texts_of(seed)
    rows = minhash.minhash_near_dup(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()
    assert [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in rows] == expected(texts)


def test_what_stars_leave_goes_through_the_prefix_join(spark, monkeypatch):
    """Without any candidate of their own, buckets are torn, and all links come from the exact join."""
    monkeypatch.setattr(minhash, "GROUP", 1)
    monkeypatch.setattr(minhash, "candidates", lambda shared, least: shared.select(shared["node"].alias("a"), shared["node"].alias("b")).limit(0))
    texts = texts_of(3)
    rows = minhash.minhash_near_dup(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()
    assert [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in rows] == expected(texts)


def test_other_thresholds_and_long_texts(spark):
    r = random.Random(9)
    long = [f"v{r.randrange(10**6)}" for _ in range(300_000)]
    near = [w if i % 200 else "changed" for i, w in enumerate(long)]
    texts = [" ".join(long), " ".join(near), " ".join(long[:200_000]), " ".join(long[:5]), " ".join(long[:6])]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert [x["component_id"] for x in minhash.minhash_near_dup(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3, 4]
    assert [x["component_id"] for x in minhash.minhash_near_dup(docs, (1, 2), 100, 2).orderBy("doc_id").collect()] == [0, 0, 0, 3, 3]


def test_edges(spark):
    text = "one two three four five six seven"
    more = [None] * 9
    rows = [(None, text, *more), (4, text, "k", "k", "k", 1, 1, 1, "k", "k", 1), (2, text + " ", *more), (2, text, *more), (9, None, *more), (None, "", *more), (None, "x y", *more), (None, "x  Y", *more)]
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"]), x["kept"]) for x in minhash.minhash_near_dup(spark.createDataFrame(rows, CLASHING)).collect())
    assert got == sorted([("2", 3, "2", True), ("2", 3, "2", True), ("4", 3, "2", False), ("9", 0, "9", True), ("None", 0, "None", True), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 3, "2", False)])
    assert minhash.minhash_near_dup(spark.createDataFrame([], CLASHING)).count() == 0
    # Without any id: links still join different texts.
    base = [f"n{i}" for i in range(60)]
    none = spark.createDataFrame([(None, " ".join(base)), (None, " ".join(base[1:])), (7, " ".join(base[2:]))], DOCS)
    assert [x["component_id"] for x in minhash.minhash_near_dup(none).collect()] == [7, 7, 7]


def test_no_level_is_thrown_twice():
    values = np.concatenate([minhash._thrown(mixed(np.arange(50, dtype=np.uint64)), j, 60)[0] for j in range(60)])
    assert len(np.unique(values)) == 3000
