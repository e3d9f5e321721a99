import importlib
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import language_id, quality, source_mix

SF = "/root/testdata/sf0.01"


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)
    tried = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in tried) / len(tried) > 0.85
    good, bad = ([r["score"] for r in tried if r["quality"] == v] for v in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    # Calibration: the mean score is the share of good labels, within a few points.
    assert abs(sum(r["score"] for r in tried) / len(tried) - len(good) / len(tried)) < 0.1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words flow here " * 20 if i % 2 else "%%% $$$ !! " * 20, "s", 1) for i in range(40)] + [(None, None, "s", 1), (41, "", "s", 1)], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(2, 1, None), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(rows[i]["predicted"] == i % 2 for i in range(40)) and 0 <= rows[41]["score"] <= 1 and rows[None]["held_out"] is False
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(40) if i % 2}
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_of_long_texts():
    import random

    r = random.Random(5)
    phrases = {k: [" ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(5)) for _ in range(20000)] for k, letters in (("good", "abcdefghij"), ("bad", "klmnopqrst"))}
    said = lambda k, n: " ".join(r.choice(phrases[k]) for _ in range(n // 35 + 1)).encode()[:n]
    model = quality.CompressionModel(" ".join(phrases["good"]).encode(), " ".join(phrases["bad"]).encode(), 1.0, 0.0, 0.5)
    short, long, turned = model.difference([said("good", 16 << 10), said("good", 6 << 20), said("good", 1 << 20) + said("bad", 5 << 20)])
    assert long == pytest.approx(short, rel=0.1) and turned == pytest.approx(-4 / 6 * short, rel=0.1)


def test_quality_sizes_are_those_of_the_pieces():
    import zstandard

    model = quality.CompressionModel(b"good words flow " * 200, b"%%% $$$ !! " * 200, 1.0, 0.0, 0.5)
    size = lambda d, t: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(t))
    for text in (b"", b"good words", b"good words flow here " * 3000, b"%%% good " * 5000):
        pieces = [text[i : i + quality.PIECE_BYTES] for i in range(0, len(text), quality.PIECE_BYTES)]
        assert model.difference([text]) == [sum(size(model.bad, p) - size(model.good, p) for p in pieces) / (len(text) + 1)]


def test_dictionaries_hold_the_ends_of_texts():
    text = b"".join(b"%07d " % i for i in range(200000))
    part = quality.spread(text, 8 << 10)
    assert len(part) <= 9 << 10 and text[:100] in part and text[-100:] in part and text[len(text) // 3 * 2 :][:20000].count(b" ") > 0
    assert quality.spread(b"short", 8 << 10) == b"short"
    left, right = b"good words flow here " * 50000, b"%%% $$$ !! @@ " * 75000
    model = quality.CompressionModel(quality._dictionary([left]), quality._dictionary([right]), 1.0, 0.0, 0.5)
    one, other = model.difference([left + right, right + left])
    assert abs(one - other) < 0.002


def test_quality_prior_counts_all_labels(spark):
    docs = spark.createDataFrame([(i, "good words flow here " * 20 if i % 4 else "%%% $$$ !! " * 20) for i in range(200)] + [(900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    trained = [i for i in range(200) if not held_out(i)]
    rows = {x["doc_id"]: x["score"] for x in quality.quality_scores(docs, labels, 10).collect()}
    assert rows[900] == pytest.approx(sum(i % 4 > 0 for i in trained) / len(trained))


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_scores(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tried = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in tried) / len(tried) > 0.95


def test_votes_are_those_of_all_pairs():
    import random
    from itertools import combinations

    import numpy as np

    r = random.Random(4)
    letters = {"en": "abcde", "de": "cdefg", "nl": "efghi", "fr": "jklmn", "es": "lmnop"}
    said = lambda k: " ".join("".join(r.choice(letters[k]) for _ in range(4)) for _ in range(30))
    rows = [(said(k), k) for k in letters for _ in range(12)]
    sparse = [(np.flatnonzero(x := language_id.features(t)), x[np.flatnonzero(x)], k) for t, k in rows]
    model = language_id.fit(sparse)
    for text, _ in rows:
        x = np.append(language_id.features(text), 1.0)
        family = max(sorted(model.family_weights), key=lambda f: model.family_weights[f] @ x)
        inside = [k for k in model.languages if language_id.FAMILIES[k] == family]
        votes = {k: [0, 0.0] for k in inside}
        for a, b in combinations(inside, 2):
            m = model.pair_weights[a, b] @ x
            votes[a if m > 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        assert model.predict(text)[0] == max(inside, key=lambda k: votes[k])
    assert sum(model.predict(t)[0] == k for t, k in rows) / len(rows) > 0.95


def test_language_edges(spark):
    said = {"en": "the cat and the dog with that thing", "de": "der hund und die katze mit schönem ding", "fr": "le chat et la chienne avec une été", "xx": "zqzq qzqz zzqq qqzz"}
    rows = [(i, " ".join([said[k]] * (1 + i % 5)), k, "s") for i, k in enumerate([*said] * 20)]
    docs = spark.createDataFrame([*rows, (100, None, "en", "s"), (101, "", "en", "s"), (102, "123 !?", "en", "s"), (None, "the cat and that dog", None, "s")], "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.language_scores(docs).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (100, 101, 102)) and got[None]["lang_pred"] == "en"
    one = language_id.language_scores(docs.where("lang = 'fr'")).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("fr", 1.0)}
    assert {r["lang_pred"] for r in language_id.language_scores(docs.where("doc_id = 100")).collect()} == {"und"}
    assert language_id.language_scores(docs.limit(0)).count() == 0


def targets_expected(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_source_mix(spark, block):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)) + " " * (i % 2), [None, "b", "a", "É", "zz", "big"][min(i % 9, 5)]) for i in range(150)]
    rows += [(500, None, "a"), (501, "", None), (502, " \t", "only empty"), (None, "x y", "a"), (3, "a b c", "b"), (3, "a b c", "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, target long")
    got = source_mix.source_mix(docs, block, 16, 3)
    out = got.collect()
    count = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    expected = targets_expected(sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), count(t)) for i, t, _ in rows)
    assert sorted(round(r["target"], 6) for r in out) == sorted(round(expected[s], 6) for _, _, s in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    # A source gets its share of each shard's slots, but for two, and the blocks of that many slots.
    for target in {r["target"] for r in out}:
        mine = [r for r in out if r["target"] == target]
        shards = sum(sizes.values()) // block // 16 + 2
        assert abs(sum(r["taken"] for r in mine) - target * len({r["source_size"] for r in mine})) <= (2 * shards + 2) * block * max(1, len(mine))
    again = source_mix.source_mix(docs.repartition(3), block, 16, 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert source_mix.source_mix(docs.limit(0)).count() == 0
    assert {r["target"] for r in source_mix.source_mix(docs.where("doc_id in (500, 501)")).collect()} == {0.0}


def some_sources(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "abcd"[min(i % 7, 3)]) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_slots_are_drawn_and_permuted(spark):
    _, quota = source_mix.prepared(some_sources(spark), 8)
    slots = source_mix.slot_blocks(source_mix.drawn_slots(quota, 32), quota).join(quota.select("rank", "blocks", "share", "lo", "hi"), "rank").collect()
    assert sorted(r["slot"] for r in slots) == list(range(max(r["slots"] for r in quota.collect())))
    for rank in {r["rank"] for r in slots}:
        mine = [r for r in slots if r["rank"] == rank]
        assert sorted(r["k"] for r in mine) == list(range(len(mine)))
        n = mine[0]["blocks"]
        for epoch in range(3):
            blocks = [r["block"] for r in mine if r["k"] // n == epoch]
            assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(n))
        assert all((r["block"] is None) == (r["k"] >= 3 * n) for r in mine)
        for shard in {r["shard"] for r in slots}:
            size = sum(r["shard"] == shard for r in slots)
            assert abs(sum(r["shard"] == shard for r in mine) - size * (mine[0]["hi"] - mine[0]["lo"])) < 2


def test_shards_are_mixed(spark):
    """Inside a shard sources follow one another at random, not one after the other."""
    docs = some_sources(spark)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = source_mix.shard_pieces(docs, 8, 64).select("shard", "slot", "doc_id").distinct().collect()
    order, slots = {}, {}
    for r in rows:
        assert slots.setdefault(r["slot"], r["shard"]) == r["shard"] == r["slot"] // 64
        order.setdefault(r["shard"], {})[r["slot"]] = source[r["doc_id"]]
    for of in order.values():
        line = [of[k] for k in sorted(of)]
        if len(line) > 32:
            assert sum(a != b for a, b in zip(line, line[1:], strict=False)) > 2 * len(set(line))


def test_draws_decide_what_is_taken(spark):
    docs = some_sources(spark)
    drawn = [{r["rank"]: r["n"] for r in source_mix.drawn_slots(source_mix.prepared(docs, 8)[1], 32, seed).groupBy("rank").agg(F.count("*").alias("n")).collect()} for seed in (42, 7)]
    assert len({str(sorted(d.items())) for d in drawn}) > 1
    taken = [{r["source_size"]: r["n"] for r in source_mix.source_mix(docs, 8, 32, seed=seed).groupBy("source_size").agg(F.sum("taken").alias("n")).collect()} for seed in (42, 7)]
    assert len({str(sorted(t.items())) for t in taken}) > 1
    # The slots' own words add up to what is taken of each document.
    whole = {r["doc_id"]: r["taken"] for r in source_mix.source_mix(docs, 8, 32).collect()}
    parts = {r["doc_id"]: r["n"] for r in source_mix.shard_pieces(docs, 8, 32).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert {i: n for i, n in whole.items() if n} == parts


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    all_docs, labels = docs, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema).cache()
        left.append({r["doc_id"] for r in docs.collect()})
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == all_docs.columns
    assert sum(labels.get(i) == 1 for i in left[0]) / sum(v == 1 for v in labels.values()) > 0.9
    texts = {r["doc_id"]: r["text"] for r in all_docs.collect()}
    from tests.llm.test_dedup import exact_expected, near_expected
    from tests.llm.test_scans import contaminated_expected

    assert left[1] == {i for i, (keep, _, _) in exact_expected([(i, texts[i]) for i in sorted(left[0])]).items() if i == keep}
    order = sorted(left[1])
    assert left[2] == {order[i] for i, (_, c) in enumerate(near_expected([texts[i] for i in order])) if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert left[3] == {i for i in left[2] if not any(contaminated_expected(texts[i], t) for t in items)}
    assert left[4] == left[3]
    assert pipeline.run(spark, SF).count() == len(left[4])
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_as_a_chain_of_awkward_rows(spark):
    """Null ids, texts and sources, repeated rows, columns with the stages' own names and a text of 10 MB, all the way."""
    import random

    from quern.llm.common import written

    pipeline = importlib.import_module("corpus_pipeline")
    r = random.Random(1)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    good = base.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").select("text").limit(3).collect()
    vocabulary = " ".join(x["text"] for x in good).split()
    long = " ".join(r.choice(vocabulary) for _ in range(1_700_000))
    assert len(long) > 10_000_000
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    own = " ".join(f"{w}{i}" for i, w in enumerate(vocabulary[:200]))
    rows = [(None, good[0]["text"]), (None, good[0]["text"]), (7_000_000, None), (7_000_001, own), (7_000_001, own), (None, own + "  "), (7_000_002, own.upper() + " one more"), (7_000_003, f"{own} and {item}"), (7_000_004, long), (None, None), (7_000_005, "")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], base.schema)
    docs = base.unionByName(more).withColumns({c: F.lit("x") for c in ("_row_key", "group_id", "keep_id", "fp", "cls", "key", "n", "score", "token", "seed")})
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns and docs.where("_row_key <> 'x' or key <> 'x' or seed <> 'x'").count() == 0
    kept = docs.where("doc_id is null or doc_id >= 7000000").select("doc_id", F.length("text").alias("n")).collect()
    ids = [x["doc_id"] for x in kept]
    # The classifier decides which stay; of what stays there is one row of each group, and none that holds a benchmark item.
    assert len(set(ids)) == len(ids) or ids.count(None) == 1
    assert sum(i in (7_000_001, 7_000_002) for i in ids) <= 1 and 7_000_003 not in ids
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
