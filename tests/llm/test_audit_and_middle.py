import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import fill_middle, source_audit

CUT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"(?s)."}
CLASHING = "doc_id long, text string, lang string, source string, term string, n long, p long, salt int, form string, output string, value long"


@given(st.text(alphabet="ab \n\té😀\x0b", max_size=60), st.sampled_from(["line", "word", "char"]))
@settings(max_examples=300, deadline=None)
def test_every_cut_of_a_text(text, unit):
    data = np.frombuffer(text.encode(), np.uint8)
    runs, units = fill_middle.Runs(data, unit), re.findall(CUT[unit], text)
    assert runs.units == len(units)
    assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def middle_expected(doc_id, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(CUT[unit], text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_texts():
    r = random.Random(3)
    many = ["".join(r.choice(["a", "é", "😀 b", "\n", "\n\n", " ", "<", "<P", "S>", "\\n"]) for _ in range(r.randrange(40))) for _ in range(60)]
    return [*many, None, "", "\n", "\n\n\n", "x", "a<P>b\nc", "<S>", "<M>\n", "ends\nopen", "ends\n", "line\n" * 300_000 + "é" * 1_000_000]


@pytest.mark.parametrize(("unit", "rate", "spm", "seed"), [("line", 100, 50, 7), ("word", 60, 0, 1), ("char", 100, 100, 2)])
def test_fill_in_middle(spark, unit, rate, spm, seed):
    texts = middle_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, unit, rate, spm, seed)
    rows = out.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).orderBy("doc_id").collect()
    assert [(x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in rows] == [middle_expected(i, t, unit, rate, spm, seed) for i, t in enumerate(texts)]
    assert [x["back"] for x in rows] == [t or "" for t in texts]


def test_fill_in_middle_edges(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc", *[None] * 9), (3, "a\nb\nc", "k", "k", "k", 1, 1, 1, "psm", "x", 1), (3, "a\nb\nc", *[None] * 9), (4, None, *[None] * 9)], CLASHING)
    rows = fill_middle.fim_digest(fill_middle.fill_in_middle(docs)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for x in rows:
        text = None if x["doc_id"] == 4 else "a\nb\nc"
        *same, output = middle_expected(x["doc_id"], text)
        assert [*x] == [x["doc_id"], *same, sha(output), sha(text or "")]
    assert len(rows) == 4 and fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    other = fill_middle.fill_in_middle(docs, sentinels=("[pre]", "{suf}", "(mid)"))
    assert {x[0] for x in other.select(fill_middle.restored(F.col("output"), F.col("form"), ("[pre]", "{suf}", "(mid)"))).collect()} == {"a\nb\nc", ""}
    for bad in (("aa", "b", "c"), ("a", "a", "b"), ("", "a", "b"), ("<P>", "<S<", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.fill_in_middle(docs, sentinels=bad)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_in_middle(docs, "page")


def audit_expected(rows, min_docs, smooth, top):
    count, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: [count[lang, s, t] for t in kept] for s in sources}
        p = lambda c: [1 + 10**9 * (x + smooth) // (sum(c) + smooth * len(kept)) for x in c]
        q = p([sum(x) for x in zip(*n.values(), strict=True)])
        for s in sources:
            pair = [(sum(abs(x - y) for x, y in zip(p(n[s]), p(n[o]), strict=True)), o) for o in sources if o != s]
            term = [(x - y, t) for x, y, c, t in zip(p(n[s]), q, n[s], kept, strict=True) if c and x > y]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def audit_rows():
    r = random.Random(4)
    words = ["Ab", "aB", "ab", "é", "É", "日本", "z😀", "x", "y", "w", "it's", "n1n", "---"]
    rows = []
    for lang in ("en", "", None, "fr"):
        for source in ("a", "b", "B", None, "", "é"):
            some = r.sample(words, 8)
            rows += [(lang, source, " ".join(r.choice(some) for _ in range(r.randrange(12)))) for _ in range(r.randrange(1, 9))]
    return [*rows, ("rare", "a", "one"), ("rare", "b", "two"), ("rare", "c", None), ("alone", "s", "q q q"), ("none", "x", None), ("none", "y", ""), ("en", "long", "Ab x " * 200_000)]


@pytest.mark.parametrize(("least", "smooth", "top"), [(3, 5, 50), (2, 1, 2), (1000, 5, 50)])
def test_source_divergence(spark, least, smooth, top):
    rows = audit_rows() * 2
    got = source_audit.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least, smooth, top)
    assert sorted(tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in got.collect()) == audit_expected(rows, least, smooth, top)


def test_source_divergence_edges(spark):
    rows = [(i, "Same words here" if i % 2 else "here other", "en", f"s{i % 3}", "t", 1, 1, 1, "f", "o", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = source_audit.source_divergence(docs, 5).collect()
    assert sorted(tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in got) == audit_expected([(x[2], x[3], x[1]) for x in rows], 5, 5, 50)
    assert source_audit.source_divergence(docs.limit(0)).count() == 0
    by = defaultdict(list)
    for x in got:
        by[x["lang"], x["source"], x["part"]].append(x["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_shares_are_exact_beyond_long_arithmetic(spark):
    n, total, terms = 9_000_000_000_000, 9_123_456_789_012_345, 7_654_321
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(source_audit.smoothed("n", "total", "terms")).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)
