import json
import math

import pytest
from pyspark.sql import functions as F

from quern.operators import mix, preferences, reports, scaling, score, sft, splits, tokens, windows


def test_hash_split_value(spark):
    df = spark.createDataFrame([("hello",)], "text string")
    assert df.select(splits.hash_fraction(F.col("text"))).first()[0] == 0.77114
    assert splits.hash_split(df).first()["split"] == "train"


@pytest.mark.parametrize(("n", "sizes"), [(100, (70, 10, 20)), (101, (70, 10, 21)), (999, (699, 100, 200)), (0, (0, 0, 0))])
def test_char_split(spark, n, sizes):
    text = "".join(chr(97 + i % 26) for i in range(n))
    s = spark.createDataFrame([(text,)], "text string").select(splits.char_split(F.col("text"), 0.1, 0.2).alias("s")).first()["s"]
    assert tuple(map(len, s)) == sizes
    assert "".join(s) == text


@pytest.mark.parametrize(("n", "val"), [(1000, 50), (2000, 100), (40, 40), (0, 0)])
def test_tail_split(spark, n, val):
    rows = splits.tail_split(spark.range(n), "id").collect()
    assert len(rows) == n and sum(r["split"] == "val" for r in rows) == val


def test_pillars():
    assert splits.pillar_budgets(15000) == {"code": 3750, "reasoning": 3750, "constraints": 3000, "dialogue": 2250, "synthetic": 2250}


WEIGHTS = {
    (10_000_000, 125_000_000): (0.414474, 0.177632, 0.157895, 0.08, 0.06, 0.11),
    (10_000_000_000, 125_000_000): (0.440779, 0.188905, 0.167916, 0.0484, 0.044, 0.11),
    (10_000_000_000, 350_000_000): (0.433263, 0.185684, 0.165053, 0.066, 0.06, 0.09),
    (10_000_000_000, 1_000_000_000): (0.473937, 0.203116, 0.180547, 0.0484, 0.044, 0.05),
    (80_000_000_000, 350_000_000): (0.494191, 0.211796, 0.188263, 0.00825, 0.0075, 0.09),
}


@pytest.mark.parametrize("case", WEIGHTS)
def test_curriculum_weights(spark, case):
    rows = mix.curriculum_weights(mix.curriculum(spark), *case).orderBy("id").collect()
    assert [r["weight"] for r in rows] == pytest.approx(WEIGHTS[case], abs=1e-6)


def test_packing_keeps_weights_and_budget(spark):
    docs = spark.createDataFrame([("general", 0, 4), ("general", 1, 3), ("code", 0, 3), ("code", 1, 4), ("math", 0, 5)], "source string, pos long, n long")
    weights = spark.createDataFrame([("general", 0.6), ("code", 0.2), ("math", 0.2)], "source string, weight double")
    order = mix.weighted_order(docs, weights, 10_000)
    pieces = mix.shard_pieces(order, 2_500, 10_000)
    shards = {r["shard"]: r["n"] for r in pieces.groupBy("shard").agg(F.sum("length").alias("n")).collect()}
    assert shards == dict.fromkeys(range(4), 2500)
    share = {r["source"]: r["n"] / 10_000 for r in pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert share == pytest.approx({"general": 0.6, "code": 0.2, "math": 0.2}, abs=0.01)
    ids = docs.withColumn("ids", F.expr("array_repeat(cast(n as int), cast(n as int))"))
    assert mix.shard_tokens(pieces, ids).agg(F.sum(F.size("tokens"))).first()[0] == 10_000
    assert mix.validation_tokens(10_000) == 50_000 and mix.validation_tokens(10**10) == 2_000_000


def turns(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def test_preferences(spark):
    listed = {"chosen": turns(("system", "S"), ("user", "old"), ("user", " Q "), ("assistant", "A b")), "rejected": turns(("user", "Q"), ("assistant", "B"))}
    long = " ".join(["w"] * 351)
    records = [
        listed,
        {"prompt": "P", "chosen": "yes it is", "rejected": "no"},
        {"prompt": "P", "chosen": "same", "rejected": "same "},
        {"prompt": "P", "chosen": long, "rejected": "no " * 100},
        {"prompt": "P", "chosen": "w " * 350, "rejected": "x " * 100},
        {"prompt": "P", "chosen": "w " * 8, "rejected": "x"},
        {"prompt": "P", "chosen": "w " * 9, "rejected": "x"},
        {"prompt": None, "question": None, "instruction": "I", "chosen": {"role": "assistant", "content": "c"}, "rejected": "r"},
        {"prompt": None, "question": None, "chosen": "c", "rejected": "r"},
        {"prompt": turns(("system", "T"), ("user", "u1"), ("user", "u2")), "chosen": "c", "rejected": "r"},
        {"prompt": "P", "chosen": turns(("assistant", "a"), ("user", "u")), "rejected": "r"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, json string")
    kept = {r["i"]: r for r in preferences.pairs(df).collect()}
    assert sorted(kept) == [0, 1, 4, 5, 7, 9]
    assert tuple(kept[0][k] for k in ("system", "prompt", "chosen", "rejected")) == ("S", "Q", "A b", "B")
    assert kept[1]["system"] is None and kept[7]["prompt"] == "I" and (kept[9]["prompt"], kept[9]["system"]) == ("u2", "T")


def test_dpo_terms(spark):
    df = spark.createDataFrame([(-1.0, -8.0, -4.0, -4.0), (-8.0, -1.0, -4.0, -4.0)], "a double, b double, c double, d double")
    rows = df.withColumns(preferences.dpo_terms(*map(F.col, "abcd"))).collect()
    assert (rows[0]["reward_chosen"], rows[0]["reward_rejected"], rows[0]["margin"], rows[0]["win"]) == pytest.approx((0.3, -0.4, 0.7, 1.0))
    assert rows[0]["loss"] == pytest.approx(math.log1p(math.exp(-0.7))) and rows[1]["loss"] > rows[0]["loss"] and rows[1]["win"] == 0.0


def test_labels_padding_and_window(spark):
    turn = "array<struct<role:string,role_ids:array<int>,content_ids:array<int>>>"
    df = spark.createDataFrame([(0, [("user", [1], [2, 3]), ("assistant", [4], [5, 6, 7])]), (1, [("user", [1], [])])], f"id int, turns {turn}")
    rows = df.select("id", F.inline(F.array(sft.labelled(F.col("turns"), 100)))).cache()
    first = rows.where("id = 0").first()
    assert first["input_ids"] == [50257, 1, 10, 2, 3, 50258, 10, 50257, 4, 10, 5, 6, 7, 50258, 10]
    assert first["labels"] == [-100] * 10 + [5, 6, 7, 50258, -100]
    padded = {r["id"]: r for r in sft.padded(sft.batched(rows, "id", 2), [("input_ids", "labels")]).collect()}
    assert {len(r["input_ids"]) for r in padded.values()} == {16}
    assert padded[1]["input_ids"][5:] == [50259] * 11 and padded[1]["labels"] == [-100] * 16 and padded[1]["input_ids_mask"] == [1] * 5 + [0] * 11
    cut = sft.padded(sft.batched(rows, "id", 2), [("input_ids", "labels")], most=8).where("id = 0").first()
    assert len(cut["input_ids"]) == 8
    w = spark.range(1).select(sft.scoring_window(F.expr("sequence(1, 10)"), F.expr("sequence(20, 22)"), 6, 0).alias("w")).first()["w"]
    assert w["ids"] == [8, 9, 10, 20, 21, 22] and w["from_index"] == 2


def test_dialogues(spark):
    df = spark.createDataFrame([(1, 0, "user", "\n  hi  "), (1, 1, "assistant", " x\n"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", " \n")], "conv_id long, turn long, role string, text string")
    kept = sft.gate(sft.dialogues(df)).collect()
    assert [(r["conv_id"], [m["content"] for m in r["messages"]]) for r in kept] == [(1, ["  hi", " x"])]
    said = sft.dialogues(df).where("conv_id = 1").select(sft.chatml(F.col("messages"), F.lit(" "), cue=True)).first()[0]
    assert said == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n<|im_start|>assistant\n"


def test_windows(spark):
    s = spark.createDataFrame([(0, list(range(100)))], "id int, tokens array<int>")
    rows = windows.sliding_windows(s, 8).orderBy("start").collect()
    assert len(rows) == 92 and rows[0]["x"] == list(range(8)) and rows[0]["y"] == list(range(1, 9))
    long = spark.createDataFrame([(0, list(range(5000)))], "id int, tokens array<int>")
    blocks = windows.rank_blocks(long, 2, 64, 2).orderBy("block").collect()
    assert [r["x"][0][0] for r in blocks[:2]] == [0, 128] and [r["rank"] for r in blocks[:2]] == [0, 1]
    assert sum(len(r["x"]) for r in blocks) == 2 * (4999 // 128) and blocks[0]["y"][1][0] == 65
    assert windows.tiled(spark.createDataFrame([([1, 2, 3],)], "tokens array<int>"), 7).first()["tokens"] == [1, 2, 3, 1, 2, 3, 1]
    assert len(windows.eval_chunks(s, 10, 50).collect()) == 4
    drawn = windows.random_windows(s, 8, 50).collect()
    assert len(drawn) == 50 and all(0 <= r["start"] < 91 for r in drawn)


def test_scores(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0, 2.0])], "id int, v array<double>")
    r = df.select(score.argmax(F.col("v")).alias("a"), score.top_k(F.col("v"), 1).alias("k"), score.penalised(F.col("v"), F.array(F.lit(1)), 2.0).alias("p")).first()
    assert (r["a"], r["k"], r["p"]) == (1, [False, True, True, False], [1.0, 1.5, 3.0, 2.0])
    kept = {x["index"]: x["kept"] for x in score.nucleus(df, ["id"], "v", 0.5).collect()}
    assert kept == {0: False, 1: True, 2: True, 3: False}
    texts = spark.createDataFrame([("a #### 1,234", "x</think> 5 then 1234"), ("#### 18", "18.0"), ("none", "3")], "g string, s string")
    assert tuple(score.answer_accuracy(texts, "g", "s").first()) == (50.0, 50.0, 2)
    losses = spark.createDataFrame([(2.0, 1), (4.0, 3)], "loss double, n int")
    assert tuple(score.perplexity(losses, "loss", "n").first()) == (3.5, 33.12)
    assert tuple(score.perplexity(losses.where("n > 9"), "loss", "n", clamp=True).first()) == (0.0, 0.0)


def test_scaling(spark):
    a = scaling.architecture(spark, 125_000_000, 50_273).first()
    assert a["heads"] * 64 == a["width"] and abs(a["params"] - 125_000_000) < 20_000_000
    tiny = scaling.architecture(spark, 1000, 50_273).first()
    assert (tiny["width"], tiny["layers"]) == (192, 8)
    lr = spark.range(5).select(scaling.cosine_rate(F.col("id"), 2, 4, 1.0, 0.1).alias("r")).collect()
    assert [x["r"] for x in lr] == pytest.approx([0.5, 1.0, 1.0, 0.55, 0.1])


def test_tokens(spark):
    df = spark.createDataFrame([("Hi é<think>ok</think>",), ("",)], "text string")
    ids = tokens.byte_ids(F.col("text"))
    got = [r[0] for r in df.select(ids).collect()]
    assert got[1] == [50256] and got[0][:2] == [ord("H") - 33, ord("i") - 33] and len(got[0]) == len("Hi é<think>ok</think>".encode()) + 1
    assert df.select(tokens.special_spans(F.col("text"))).first()[0] == ["Hi é", "<think>", "ok", "</think>"]
    pairs = {(r["left"], r["right"]): r["n"] for r in tokens.pair_counts(spark.createDataFrame([("aab", 3), ("c", 5)], "piece string, n long")).collect()}
    assert pairs == {("61", "61"): 3, ("61", "62"): 3}


def test_reports(spark):
    files = spark.createDataFrame([("pretrain/train_00000.bin", 10), ("sft/train.jsonl", 5), ("dpo/train.jsonl", 60_000)], "path string, length long")
    assert [r[0] for r in reports.missing_data(files).collect()] == ["no validation shard"]
    assert {r["stage"]: (r["files"], r["bytes"]) for r in reports.stage_files(files).collect()} == {"pretrain": (1, 10), "sft": (1, 5), "dpo": (1, 60_000)}
    assert tuple(reports.enough_tokens(files, 1).first()) == (30_007, True)
    counts = spark.createDataFrame([("a", 300, None, None), ("b", 100, "u", "s")], "source string, tokens long, upstream string, status string")
    assert "- a: 300 tokens (75.00 %), from Custom, 100% Unique" in reports.card(reports.source_table(counts), reports.corpus_summary(counts, ("b",)))
