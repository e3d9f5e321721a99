import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from quern.sources import readers, sinks
from quern.streaming import incremental


def test_corpus_readers(spark, tmp_path):
    long = "x" * 31
    spark.createDataFrame([(long,), ("  short  ",), (None,)], "content string").write.parquet(str(tmp_path / "a.parquet"))
    assert [r["text"] for r in readers.read_corpus(spark, [str(tmp_path / "a.parquet")]).collect()] == [long]
    spark.createDataFrame([("p", " s "), ("", "s")], "problem string, solution string").write.parquet(str(tmp_path / "r.parquet"))
    assert [r["text"] for r in readers.read_reasoning(spark, [str(tmp_path / "r.parquet")], think=True).collect()] == ["Problem:\np\n\nSolution:\n<think>\ns\n</think>"]


def test_jsonl(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"text": " a "}\n\n{broken\n[1]\n{"text": null}\n{"other": 1}\n{"text": "b"}\n')
    assert sorted(r["text"] for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl.gz")).collect()) == ["a", "b"]


def test_dialogues(spark, tmp_path):
    turns = [{"role": "user", "content": "hi"}]
    (tmp_path / "a.jsonl").write_text(json.dumps({"messages": turns}) + "\n" + json.dumps({"conversations": turns * 2}) + "\n" + json.dumps({"messages": []}) + "\n")
    assert sorted(len(r["messages"]) for r in readers.read_dialogues(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    (tmp_path / "b.json").write_text(json.dumps([{"messages": turns}]))
    assert readers.read_dialogues(spark, str(tmp_path / "b.json")).count() == 1
    assert readers.read_dialogues(spark, "x.txt").count() == 0


def test_file_choice(spark, tmp_path):
    for name in ("data/python/a.jsonl", "data/python-x/b.jsonl.gz", "data/c.parquet", "other/d.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = readers.listing(spark, str(tmp_path))
    pick = lambda *a: [r["path"] for r in readers.pick_files(files, *a).collect()]
    assert pick("/data/python") == ["data/python-x/b.jsonl.gz", "data/python/a.jsonl"]
    assert pick("data") == ["data/c.parquet"]


def test_shards_round_trip(spark, tmp_path):
    rows = [(0, 0, [1, 2, 50256]), (0, 3, [7, 50256]), (1, 0, [65535]), (1, 1, [9, 50256])]
    sinks.write_shards(spark.createDataFrame(rows, "shard long, at long, tokens array<int>"), str(tmp_path / "bin"))
    assert np.fromfile(tmp_path / "bin/train_00000.bin", "<u2").tolist() == [1, 2, 50256, 7, 50256]
    assert np.fromfile(tmp_path / "bin/train_00001.bin", "<u2").tolist() == [65535, 9, 50256]
    files = readers.token_files(spark, str(tmp_path / "bin"), "train")
    assert files.agg(F.sum("length")).first()[0] == 16
    docs = readers.read_token_documents(spark, readers.shard_paths(spark, str(tmp_path / "bin"), "train"), 50256).orderBy("path", "pos").collect()
    assert [r["ids"] for r in docs] == [[1, 2], [7], [65535, 9]]
    assert readers.token_files(spark, str(tmp_path / "bin"), "val").count() == 0


def test_splits_and_jsonl_sink(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, [1, 2]), ("val", 1, [3]), ("train", 2, [4, 5])], "split string, pos long, ids array<int>")
    sinks.write_splits(df, str(tmp_path / "s"), "split", "ids", "pos", 3)
    assert np.fromfile(tmp_path / "s/train_00000.bin", "<u2").tolist() == [1, 2, 4]
    assert np.fromfile(tmp_path / "s/train_00001.bin", "<u2").tolist() == [5]
    assert np.fromfile(tmp_path / "s/val_00000.bin", "<u2").tolist() == [3]
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "prompt string, system string"), str(tmp_path / "j"))
    assert [line for p in (tmp_path / "j").glob("*.json") for line in p.read_text().splitlines()] == ['{"prompt":"é"}']


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"encoder": {"a": 0, "b": 1}, "merges": ["a b", "ab c d"]}))
    words, merges = readers.read_vocabulary(spark, str(tmp_path / "v.json"))
    assert words.count() == 2 and [tuple(r) for r in merges.orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "c d")]


def test_vocabulary_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("b\n", 1), ("a", 0), ('"é', 2)], "token string, id int").repartition(3)
    merges = spark.createDataFrame([(1, "ab", "c"), (0, "a", "b")], "rank int, left string, right string")
    sinks.write_vocabulary(words, merges, ["<|end|>"], str(tmp_path / "v"))
    (line,) = [x for p in (tmp_path / "v").glob("part-*") for x in p.read_text().splitlines()]
    assert list(json.loads(line).items()) == [("special_tokens", ["<|end|>"]), ("encoder", {"a": 0, "b\n": 1, '"é': 2}), ("merges", ["a b", "ab c"])]
    again, ranks = readers.read_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, words.collect())) and sorted(map(tuple, ranks.collect())) == sorted(map(tuple, merges.collect()))
    sinks.write_vocabulary(words.limit(0), merges.limit(0), [], str(tmp_path / "none"))
    assert readers.read_vocabulary(spark, str(tmp_path / "none"))[0].count() == 0


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i + 3), "s") for i in range(40)], "doc_id long, text string, source string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    incremental.write_new(incremental.new_documents(spark, str(tmp_path / "in"), files=2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r["doc_id"], r["split"], r["tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["doc_id"], r["split"], r["tokens"]) for r in incremental.prepared(docs).collect())


def test_totals_go_on_after_a_restart(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " * (i % 7 + 4), "s") for i in range(90)], "doc_id long, text string, source string")
    folder, checkpoint = str(tmp_path / "totals"), str(tmp_path / "check")
    run = lambda: incremental.keep_totals(incremental.new_documents(spark, str(tmp_path / "in"), files=1), folder, checkpoint).awaitTermination()
    seen = docs.limit(0)
    for lot in range(3):
        more = docs.where(F.col("doc_id") % 3 == lot)
        more.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        seen = seen.unionByName(more)
        run()
        want = {r["split"]: (r["docs"], r["tokens"]) for r in incremental.totals(seen).collect()}
        assert {r["split"]: (r["docs"], r["tokens"]) for r in incremental.latest_totals(spark, folder).collect()} == want
    run()  # nothing new
    assert {r["split"]: (r["docs"], r["tokens"]) for r in incremental.latest_totals(spark, folder).collect()} == want


def test_windows_with_late_rows_and_a_restart(spark, tmp_path):
    """Late rows within the hour count, later ones are dropped, and open windows survive the restart."""
    schema = "ts timestamp, kind string"
    lots = [["12:01", "12:05", "12:14"], ["13:30", "12:45", "12:41"], ["12:03", "13:01", "13:31", "14:55"], ["16:20"], ["12:44", "16:21"]]
    run = lambda: incremental.keep_counts(incremental.running_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "kind"), "kind", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    minutes = lambda t: int(t[:2]) * 60 + int(t[3:])
    want, watermark = {}, 0
    for i, lot in enumerate(lots):
        spark.createDataFrame([(f"2024-01-01 {t}:00", "a") for t in lot], "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        for t in lot:
            begin = minutes(t) // 10 * 10
            if begin + 10 > watermark:
                want[begin] = want.get(begin, 0) + 1
        watermark = max(watermark, max(map(minutes, lot)) - 60)
        got = {r["begin"].hour * 60 + r["begin"].minute: r["n"] for r in spark.read.schema("begin timestamp, kind string, n long").parquet(str(tmp_path / "out")).collect()}
        assert got == {b: n for b, n in want.items() if b + 10 <= watermark}, i
    assert want[720] == 2 and want[760] == 2 and got[840 + 50] == 1
