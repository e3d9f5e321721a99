import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from quern.operators import merges, tokens
from quern.sources import readers


def alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def trained(texts, count):
    """A merge table as training gives it: the most frequent pair, again and again."""
    letters = alphabet()
    words = [[letters[b] for b in p.encode()] for t in texts for p in regex.findall(tokens.PIECES, t)]
    out = []
    for _ in range(count):
        pairs = {}
        for w in words:
            for pair in zip(w, w[1:], strict=False):
                pairs[pair] = pairs.get(pair, 0) + 1
        if not pairs:
            break
        out.append(max(sorted(pairs), key=pairs.get))
        words = [one_merge(w, out[-1]) for w in words]
    return out


def one_merge(word, pair):
    out, i = [], 0
    while i < len(word):
        if tuple(word[i : i + 2]) == pair:
            out.append("".join(pair))
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def plain(text, ranks, ids, end):
    """The merge loop as it is usually written: the lowest-ranked pair of a piece until none is left."""
    letters, out = alphabet(), []
    specials = sorted(tokens.SPECIAL_TOKENS, key=len, reverse=True)
    for part in regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text or ""):
        if part in tokens.SPECIAL_TOKENS:
            out.append(tokens.SPECIAL_TOKENS[part])
            continue
        for piece in regex.findall(tokens.PIECES, part):
            word = [letters[b] for b in piece.encode()]
            while known := [(ranks[p], p) for p in zip(word, word[1:], strict=False) if p in ranks]:
                word = one_merge(word, min(known)[1])
            out += [ids[t] for t in word]
    return [*out, end]


def tables(spark, pairs):
    rows = list(alphabet().values()) + ["".join(p) for p in pairs]
    ids = {t: i for i, t in reversed(list(enumerate(rows)))}
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "rank int, left string, right string"), spark.createDataFrame(list(ids.items()), "token string, id int"), ids


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_those_of_the_merge_loop(spark, seed):
    r = random.Random(seed)
    some = ["aaaa", "aaa", "abab", " the", "then", "é", "😀", "  ", "\n\n", "12", "x", "'ll", "<think>", "<|endoftext|>", "<|im_", "!!", "\x00"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(60)]
    pairs = trained(texts, 60)
    table, vocabulary, ids = tables(spark, pairs)
    texts += [None, "", "a" * 700, "ab" * 300 + "\n", "never seen: ü∂"]
    got = merges.encode_by_merges(spark.createDataFrame([*enumerate(texts), (None, "the then")], "doc_id int, text string"), table, vocabulary, "doc_id", end=7)
    said = {x["doc_id"]: x["ids"] for x in got.collect()}
    ranks = {p: i for i, p in enumerate(pairs)}
    assert said == {i: plain(t, ranks, ids, 7) for i, t in [*enumerate(texts), (None, "the then")]}


def test_merges_out_of_order_are_refused(spark):
    for pairs, said in (([("ab", "c"), ("a", "b")], "comes before"), ([("a", "b"), ("a", "b")], "twice")):
        with pytest.raises(ValueError, match=said):
            merges.check_merges(tables(spark, pairs)[0])
    table, vocabulary, ids = tables(spark, [])
    got = merges.encode_by_merges(spark.createDataFrame([(1, "hi")], "k int, text string"), table, vocabulary, "k")
    assert got.first()["ids"] == [ids["h"], ids["i"]]
    assert merges.encode_by_merges(spark.createDataFrame([], "k int, text string"), table, vocabulary, "k").count() == 0


def test_a_public_vocabulary(spark):
    """All documents of the smallest table get the ids that the vocabulary's own library gives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vocabulary, pairs = readers.read_tokenizer(spark, "/opt/tokenizers/byte_bpe_50k.json")
    ours = {x["doc_id"]: x["ids"] for x in merges.encode_by_merges(docs, pairs, vocabulary, "doc_id", end=tokens.END_OF_TEXT).collect()}
    theirs = {x["doc_id"]: x["ids"] for x in tokens.encode(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert ours == theirs and len(ours) == 200


def test_read_tokenizer(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", ["ab", "c d"]]}}))
    vocabulary, pairs = readers.read_tokenizer(spark, str(tmp_path / "t.json"))
    assert vocabulary.count() == 3 and [tuple(x) for x in pairs.orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "c d")]


def test_bytes_of_texts(spark):
    texts = [None, "", "a", "é😀\x00", "x" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(tokens.byte_values(F.col("text")).alias("v"), tokens.byte_ids(F.coalesce("text", F.lit(""))).alias("ids"), merges.printable(F.col("text")).alias("p")).collect()
    shown = {b: i for i, b in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)])}
    place = shown | {b: len(shown) + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    letters = alphabet()
    for x, text in zip(rows, texts, strict=True):
        raw = list((text or "").encode())
        assert x["v"] == raw and x["ids"] == [*(place[b] for b in raw), tokens.END_OF_TEXT] and x["p"] == "".join(letters[b] for b in raw)


def test_a_frequent_piece_is_shuffled_once_a_chunk(spark):
    """Rows that tasks exchange follow the distinct pieces of a chunk, not how often each occurs."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in map(every.apply, range(every.size()))}
    every = store.stageList(None, False, False, none, None)
    before = stages()
    table, vocabulary, ids = tables(spark, [("t", "h"), ("th", "e"), ("Ġ", "the")])
    texts = ["the" + " the" * 20_000 + " é<think>" * k for k in range(5)]
    got = {x["k"]: x["ids"] for x in merges.encode_by_merges(spark.createDataFrame([*enumerate(texts)], "k int, text string"), table, vocabulary, "k").collect()}
    accent = [ids[c] for c in "ĠÃ©"] + [tokens.SPECIAL_TOKENS["<think>"]]
    assert got == {k: [ids["the"]] + [ids["Ġthe"]] * 20_000 + accent * k for k in range(5)}
    every = store.stageList(None, False, False, none, None)
    assert sum(n for stage, n in stages().items() if stage not in before) < 10_000


def test_texts_that_share_a_key_and_chunks_of_several_batches(spark, monkeypatch):
    table, vocabulary, ids = tables(spark, [("t", "h"), ("th", "e")])
    texts = [(1, "the"), (1, "x"), (None, "y"), (None, ""), (2, None), *((k, "the<s>" * k) for k in range(3, 40))]
    rows = spark.createDataFrame(texts, "k int, text string").coalesce(1)
    want = {k: sorted([plain(t, {("t", "h"): 0, ("th", "e"): 1}, ids, 0)[:-1] for j, t in texts if j == k]) for k, _ in texts}
    for records, most in ((3, 1 << 25), (3, 1), (1000, 200)):
        monkeypatch.setattr(merges, "CHUNK_BYTES", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = merges.encode_by_merges(rows, table, vocabulary, "k").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want)
        assert all(x["ids"] in (sum(want[x["k"]], []), sum(want[x["k"]][::-1], [])) for x in got)
