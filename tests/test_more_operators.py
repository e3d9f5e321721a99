import json
import math

import pytest
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.operators import filters, mix, preferences, profile, reports, sanitize, scaling, score, sft, splits
from quern.sources import readers


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_preference_types(spark):
    """A field's JSON type decides, not what its text begins with."""
    turn = lambda role, text: {"role": role, "content": text}
    records = [
        {"prompt": "[INST] Say hi [/INST]", "chosen": '{"a": 1}', "rejected": "[1, 2]"},
        {"chosen": [turn("system", "s"), turn("user", "u"), turn("assistant", "good")], "rejected": [turn("user", "u"), turn("assistant", "bad")]},
        {"prompt": turn("user", "p"), "chosen": turn("assistant", "good"), "rejected": turn("user", "no")},
        {"prompt": None, "question": "q", "chosen": 5, "rejected": True},
        {"instruction": "i", "chosen": [turn("user", "u")], "rejected": "r"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(5, "not json"), (6, None), (7, "[]")]
    got = {r["pos"]: (r["system"], r["prompt"], r["chosen"], r["rejected"]) for r in preferences.normalised(spark.createDataFrame(rows, "pos int, json string")).collect()}
    assert got[0] == (None, "[INST] Say hi [/INST]", '{"a": 1}', "[1, 2]")
    assert got[1] == ("s", "u", "good", "bad") and got[2] == (None, "p", "good", "") and got[3] == (None, "q", "5", "true") and got[4] == (None, "u", "", "r")
    assert got[5] == got[6] == got[7] == (None, "", "", "")
    assert [r["pos"] for r in preferences.pairs(spark.createDataFrame(rows, "pos int, json string")).orderBy("pos").collect()] == [0, 1, 3]


def test_any_number_of_openings(spark):
    text = "Sure, " * 40 + "x = 1" + "\nGood luck!" * 40
    assert values(spark, sanitize.without_preamble(F.lit(text)), sanitize.without_postamble(F.lit(text))) == [text[240:], text[: -40 * 11]]


def test_nucleus_and_summary(spark):
    kept = values(spark, *[score.nucleus_kept(F.array(*map(F.lit, v)).cast("array<double>"), 0.5) for v in ([], [1.0], [0.0, 0.0, 0.0], [5.0, 1.0, 4.9])])
    assert kept == [[], [True], [True, True, False], [True, False, False]]
    one = spark.createDataFrame([(50.0, 2)], "accuracy double, samples int")
    assert [tuple(r) for r in score.summary([("a", one), ("b", one.select("samples"))]).collect()] == [("a", "accuracy", 50.0), ("a", "samples", 2.0), ("b", "samples", 2.0)]


def test_small_column_helpers(spark):
    assert values(spark, filters.first_nonblank(F.lit(" "), F.lit(None).cast("string"), F.lit("x"))) == ["x"]
    assert values(spark, *[numbers.base_name(F.lit(x)) for x in ("org/m-sft", "m-base", "m", "m-sft-x")]) == ["org/m", "m", "m", "m-sft-x"]
    assert values(spark, *[scaling.ladder_choice(F.lit(x)) for x in (300, 100, 1, 0)]) == [256, 64, 1, 1]
    most, least = values(spark, *scaling.learning_rates(F.lit(768 * 4)))
    assert (most, least) == (pytest.approx(3e-4), pytest.approx(3e-5))
    weights = mix.normalised_weights(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double"))
    assert {r["source"]: r["weight"] for r in weights.collect()} == {"a": 0.25, "b": 0.75}
    df = spark.createDataFrame([(i, [1] * i) for i in range(5)], "id int, messages array<int>")
    assert sft.at_least(df).count() == 3
    assert sft.batched(df, "id", 2, drop_last=True).count() == 4 and sft.batched(df, "id", 8, drop_last=True).count() == 5
    rows = spark.createDataFrame([([0.1, 0.9], ["A", " b "], "B"), ([0.9, 0.1], ["A", "b"], "B")], "v array<double>, labels array<string>, right string")
    assert score.labelled_choice_accuracy(rows, "v", "labels", "right").first()["accuracy"] == 50.0


def test_more_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [r["text"] for r in readers.read_plain(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]
    (tmp_path / "p.jsonl").write_text('{"prompt": "p", "chosen": "c", "rejected": "r"}\n')
    assert readers.read_pairs(spark, str(tmp_path / "p.jsonl")).first().asDict() == {"system": None, "prompt": "p", "chosen": "c", "rejected": "r"}
    assert [r["json"] for r in readers.read_raw_json(spark, str(tmp_path / "p.jsonl")).collect()] == ['{"prompt": "p", "chosen": "c", "rejected": "r"}']
    df = spark.createDataFrame([(2, "EN"), (1, "de"), (0, "en")], "pos int, lang string")
    assert [readers.first_matching(df, x, "pos").first()["pos"] for x in (None, "de", "en")] == [0, 1, 0]
    rows = spark.createDataFrame([("", " q ", "a"), ("i", None, " "), (None, None, "a")], "instruction string, question string, answer string")
    assert [(r["prompt"], r["answer"]) for r in readers.instruction_rows(rows, ("instruction", "question", "gone"), ("answer",)).collect()] == [("q", "a")]
    code = "def f(x):\n    for y in x:\n        print(y)\n" * 10
    spark.createDataFrame([(code,), ("short",)], "content string").write.parquet(str(tmp_path / "code"))
    assert [r["text"] for r in readers.read_code(spark, [str(tmp_path / "code")]).collect()] == [code.strip()]


@pytest.mark.parametrize("budget", [0, 1, 3, 100])
def test_budget_counts(spark, budget):
    """Against the plain loop; null is no pass, and rows after the one that fills the budget don't count."""
    flags = [None, False, True, False, True, None, True, False, True]
    kept = skipped = 0
    for flag in flags:
        if flag:
            kept += 1
            if kept >= budget:
                break
        else:
            skipped += 1
    df = spark.createDataFrame(list(enumerate(flags)), "pos long, ok boolean").repartition(3)
    assert tuple(splits.budget_counts(df, F.col("ok"), budget, "pos", 2).first()) == (kept, skipped)
    assert tuple(splits.budget_counts(df.limit(0), F.col("ok"), budget, "pos", 2).first()) == (0, 0)


def test_long_texts_settle_at_their_ends(spark):
    """Marks in the middle of a text cost nothing: time goes with length."""
    import time

    def took(n):
        text = "Sure, x = 1\n" + "Good luck with this. " * n + "end"
        begun = time.monotonic()
        assert values(spark, sanitize.without_preamble(F.lit(text))) == [text[6:]]
        return time.monotonic() - begun

    took(10)
    assert took(8000) < 8 * took(2000) + 1


def test_large_masks(spark):
    """A vocabulary's worth of scores in a row, with ties."""
    n = 50_000
    v = [((i * 7919) % 1009) / 1009 for i in range(n)]
    row = spark.createDataFrame([(v,)], "v array<double>").select(score.top_k(F.col("v"), 120).alias("k"), score.nucleus_kept(F.col("v"), 0.3).alias("n")).first()
    least = sorted(v)[-120]
    assert row["k"] == [x >= least for x in v]
    order = sorted(range(n), key=lambda i: (-v[i], i))
    total, sum_, kept = sum(math.exp(x) for x in v), 0.0, set()
    for i in order:
        if sum_ > 0.3:
            break
        kept.add(i)
        sum_ += math.exp(v[i]) / total
    assert abs(sum(row["n"]) - len(kept)) <= 1 and all(row["n"][i] for i in order[: len(kept) - 1])


def test_table_driven_searches(spark):
    budgets = [1000, 20_000_000, 125_000_000, 350_000_000, 3_000_000_000]
    df = spark.createDataFrame([(b,) for b in budgets * 2], "budget long")
    size = lambda w, layers, ffn: 50_304 * w + w + layers * (2 * w * w + 2 * w * (w // 3) + 2 * w + 3 * w * ffn)
    one, two = {}, {}
    for b in budgets:
        fits, floor = [], []
        for w in range(192, 4097, 192):
            ffn = round(8 / 3 * w / 256) * 256
            layers = max(8, round((b - 50_304 * w) / (size(w, 1, ffn) - size(w, 0, ffn))))
            floor.append((size(w, 8, ffn), w, 8))
            if b > 50_304 * w and 0.010 <= layers / w <= 0.040:
                fits.append((abs(size(w, layers, ffn) - b), w, layers))
        one[b] = min(fits or floor)[1:]
        grid = []
        for w in range(384, 4096, 192):
            ffn = -(-int(8 / 3 * w) // 256) * 256
            low = max(4, int(w * 0.010))
            grid += [(abs(size(w, n, ffn) - b), w, n) for n in range(low, max(low + 2, int(w * 0.025) + 6))]
        two[b] = min(grid)[1:]
    assert {r["budget"]: (r["width"], r["layers"]) for r in scaling.architectures(df, 50_273).collect()} == one
    rows = {r["budget"]: r for r in scaling.model_plans(df).collect()}
    assert {b: (r["width"], r["layers"]) for b, r in rows.items()} == two
    for r in rows.values():
        assert r["most_rate"] == pytest.approx(6e-4 * (768 / r["width"]) ** 0.5, abs=1e-6) and r["tokens"] == 20 * r["params"] and r["batch_tokens"] % 2048 == 0


def test_curriculum_of_many_budgets(spark):
    budgets = [(10_000_000, 125_000_000), (10_000_000_000, 350_000_000), (80_000_000_000, 600_000_000), (80_000_000_000, 600_000_001)]
    got = {(r["total"], r["params"], r["source"]): r["weight"] for r in mix.curriculum_table(spark.createDataFrame(budgets, "total long, params long")).collect()}
    for total, params in budgets:
        for r in mix.curriculum_weights(mix.curriculum(spark), total, params).collect():
            assert got[total, params, r["source"]] == pytest.approx(r["weight"], abs=1e-12)


def test_families_in_the_order_they_are_seen(spark):
    rows = [(i, f, "x" * i) for i, f in enumerate("bacbacdda")]
    df = spark.createDataFrame(rows, "pos int, f string, text string").repartition(4)
    got = profile.family_stats(df, "f", pos="pos").orderBy("place").collect()
    assert [(r["f"], r["n"], r["first"]) for r in got] == [("a", 3, 1), ("b", 2, 0), ("c", 2, 2), ("d", 2, 6)]
    marked = profile.marker_counts(profile.first_rows(df.withColumn("text", F.when(F.col("pos") % 2 == 0, "def f")), "pos", 5))
    assert {r["marker"]: r["n"] for r in marked.collect()}["def "] == 3
    tags = profile.family_tags(df.select("f", "pos", F.create_map(F.lit("topic"), F.col("f")).alias("m")), "f", "m", "pos")
    assert {r["tag"]: (r["n"], r["first"]) for r in tags.collect()} == {"topic:a": (3, 1), "topic:b": (2, 0), "topic:c": (2, 2), "topic:d": (2, 6)}


def test_the_whole_card(spark):
    counts = spark.createDataFrame([("a", 3_000_000, None, None), ("b", 1_000_000, "org/b", "2 epochs")], "source string, tokens long, upstream string, status string")
    files = spark.createDataFrame([("train_00000.bin", 2000), ("x/train_00001.bin", 1500), ("val.bin", 10), ("notes.md", 7)], "path string, length long")
    text = reports.card(reports.source_table(counts), reports.corpus_summary(counts, ("b",)), "My corpus", reports.shard_summary(files), "byte pairs", 50256, reports.special_token_table(spark))
    for line in ("pretty_name: My corpus", "- n<1B", "- tokens: 4,000,000", "- reasoning: 25.0 %", "- training shards: 2 of up to 1,000 tokens (0.0 MB)", "- validation tokens: 5", "- documents end with token 50256", "- a: 3,000,000 tokens (75.00 %), from Custom, 100% Unique", "| `<|im_start|>` | 50257 | ChatML Turn Start |", "## Reading"):
        assert line in text.splitlines()
    short = reports.card(reports.source_table(counts), reports.corpus_summary(counts, ()))
    assert "## Reading" not in short and "Special" not in short
    texts = spark.createDataFrame([("<|im_start|>a<|im_end|><|im_end|>",), (None,), ("<s>",)], "text string")
    assert {r["token"]: r["n"] for r in reports.special_token_counts(spark, texts).where("n > 0").collect()} == {"<|im_start|>": 1, "<|im_end|>": 2, "<s>": 1}


def test_prompt_ids(spark):
    rows = [values(spark, sft.prompt_ids(F.array(*map(F.lit, range(n))).cast("array<int>"), 10, 4))[0] for n in (0, 3, 6, 9)]
    assert rows == [[], [0, 1, 2], [0, 1, 2, 3, 4, 5], [3, 4, 5, 6, 7, 8]]
    with pytest.raises(ValueError, match="shorter"):
        sft.prompt_ids(F.array(), 4, 4)
