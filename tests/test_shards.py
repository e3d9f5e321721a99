import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import tokens, windows
from quern.sources import readers, sinks

END = 50256


def token_docs(seed, n=60):
    r = random.Random(seed)
    return [(r.choice(["train", "val", "test"]), i, [r.randrange(65536) if r.random() < 0.9 else END for _ in range(r.randrange(9))]) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "split string, pos long, ids array<int>").repartition(3)


def read(folder):
    return {p.name: np.fromfile(p, "<u2").tolist() for p in folder.glob("*.bin")}


def expected(docs, size, end=None):
    out = {}
    for split in {d[0] for d in docs}:
        stream = [t for d in sorted(docs, key=lambda d: d[1]) if d[0] == split for t in d[2] + ([end] if end is not None else [])]
        out |= {f"{split}_{i:05d}.bin": stream[a : a + size] for i, a in enumerate(range(0, len(stream), size))} if size else {f"{split}.bin": stream}
    return out


@pytest.mark.parametrize(("size", "end"), [(7, None), (50, END), (None, None), (None, 3), (100_000, END)])
def test_all_splits_in_one_job(spark, tmp_path, size, end):
    docs = token_docs(1)
    sinks.write_splits(frame(spark, docs), str(tmp_path), "split", "ids", "pos", size, end)
    assert read(tmp_path) == expected(docs, size, end)
    (manifest,) = tmp_path.glob("_shards_*.json")
    assert {x["name"]: x["tokens"] for x in json.loads(manifest.read_text())} == {k: len(v) for k, v in expected(docs, size, end).items()}
    assert not list(tmp_path.glob("_temporary/*"))


def test_a_store_that_only_its_own_class_opens(spark, tmp_path):
    docs, folder = token_docs(2), f"only://{str(tmp_path)[1:]}/s"
    sinks.write_splits(frame(spark, docs), folder, "split", "ids", "pos", 40, END, "tests.only_store:OnlyStore")
    assert read(tmp_path / "s") == expected(docs, 40, END)
    shards = [(f"{folder}/{name}", 2 * len(v)) for name, v in expected(docs, 40, END).items()]
    got = {r["path"].rpartition("/")[2]: r["tokens"] for r in readers.read_token_ranges(spark, shards, store="tests.only_store:OnlyStore").collect()}
    assert got == expected(docs, 40, END)


def test_failed_tasks_leave_no_shard(spark, tmp_path):
    docs, folder = token_docs(3), f"only://{str(tmp_path)[1:]}"
    with pytest.raises(Exception, match="disk is gone"):
        sinks.write_splits(frame(spark, docs), f"{folder}/a", "split", "ids", "pos", 40, END, "tests.only_store:FailsAlways")
    assert not list((tmp_path / "a").glob("*.bin")) and not list((tmp_path / "a").glob("_shards_*")) and not list((tmp_path / "a").glob("_temporary/*"))
    pieces = spark.createDataFrame([("train", 0, 0, [1]), ("train", 0, 2, [2])], "split string, shard long, at long, tokens array<int>")
    for bad, said in ((pieces, "begins at 2"), (pieces.limit(1).withColumn("tokens", F.array(F.lit(70000))), "16 bits")):
        with pytest.raises(Exception, match=said):
            sinks.write_shards(bad, str(tmp_path / "b"))
    assert not list((tmp_path / "b").glob("*.bin"))


def test_a_retried_attempt_counts_once(tmp_path):
    """Two attempts of one task write apart; only the one that is committed gives shards."""
    folder = f"only://{str(tmp_path)[1:]}"
    writer = sinks._ShardWriter(folder, "job", "tests.only_store:FailsOnce")
    import pyarrow as pa
    import pyspark

    rows = [pa.RecordBatch.from_pylist([{"split": "train", "shard": k, "at": 0, "tokens": [k, k + 1]} for k in range(3)])]

    class Context:
        attempt = 0

        def taskAttemptId(self):
            Context.attempt += 1
            return Context.attempt

    context, pyspark.TaskContext.get = pyspark.TaskContext.get, lambda: Context()
    try:
        with pytest.raises(OSError, match="gone"):
            writer.write(iter(rows))
        message = writer.write(iter(rows))
    finally:
        pyspark.TaskContext.get = context
    writer.commit([None, message])
    assert read(tmp_path) == {f"train_{k:05d}.bin": [k, k + 1] for k in range(3)} and not list(tmp_path.glob("_temporary/*"))
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([message, message])


def shards_of(tmp_path, streams):
    out = []
    for i, tokens in enumerate(streams):
        np.asarray(tokens, "<u2").tofile(tmp_path / f"train_{i:05d}.bin")
        out.append((str(tmp_path / f"train_{i:05d}.bin"), 2 * len(tokens)))
    return out


@pytest.mark.parametrize(("row", "task"), [(3, 60), (64, 64), (1000, 1 << 24)])
def test_windows_and_documents_wherever_shards_are_cut(spark, tmp_path, row, task):
    r = random.Random(4)
    streams = [[r.choice([END, 1, 2, 3, 4, 5]) for _ in range(n)] for n in (200, 0, 9, 8, 1, 77)] + [list(range(1, 90)), [END] * 5]
    shards = shards_of(tmp_path, streams)
    for length, step in ((8, 1), (8, 8), (5, 12), (1, 3)):
        ranges = readers.read_token_ranges(spark, shards, length, row, task)
        assert all(x["own"] <= row and len(x["tokens"]) <= row + length for x in ranges.collect())
        got = sorted((x["path"], x["start"], x["x"], x["y"]) for x in windows.range_windows(ranges, length, step).collect())
        assert got == sorted((p, a, s[a : a + length], s[a + 1 : a + length + 1]) for (p, _), s in zip(shards, streams, strict=True) for a in range(0, len(s) - length, step))
    documents = []
    for (path, _), tokens in zip(shards, streams, strict=True):
        text = []
        pos = 0
        for t in tokens:
            if t == END:
                documents += [(path, pos, text)] if text else []
                pos, text = pos + 1, []
            else:
                text = [*text, t]
    got = readers.range_documents(readers.read_token_ranges(spark, shards, 0, row, task), END)
    assert sorted(map(tuple, got.collect())) == sorted(documents)


def test_ranges_refuse_what_they_cannot_read(spark, tmp_path):
    shards = shards_of(tmp_path, [[1, 2, 3]])
    with pytest.raises(Exception, match="ends after"):
        readers.read_token_ranges(spark, [(shards[0][0], 100)]).collect()
    with pytest.raises(Exception, match="overlap"):
        readers.read_token_ranges(spark, shards, -1).collect()
    assert readers.read_token_ranges(spark, []).count() == 0


def test_many_small_shards_are_read_by_few_tasks(spark, tmp_path):
    docs = token_docs(5, 400)
    sinks.write_splits(frame(spark, docs), str(tmp_path), "split", "ids", "pos", 9, END)
    wanted = expected(docs, 9, END)
    shards = [(f"{tmp_path}/{name}", 2 * len(v)) for name, v in wanted.items()]
    rows = readers.read_token_ranges(spark, shards, row_tokens=4, task_tokens=8)
    assert len(shards) > 150 and rows.rdd.getNumPartitions() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["path"], r["first"])):
        got.setdefault(r["path"].rpartition("/")[2], []).extend(r["tokens"])
    assert got == wanted


@pytest.mark.parametrize("end", [None, END])
def test_texts_go_to_shards_as_packed_bytes(spark, tmp_path, end):
    texts = [("train" if i % 3 else "val", i, t) for i, t in enumerate(["", "a", "\u0000\u0080ÿ€", "\U0001f600" * 9, None, "abc\n" * 20])]
    rows = spark.createDataFrame(texts, "split string, pos long, text string").select("split", "pos", tokens.packed_bytes(F.col("text")).alias("ids"))
    sinks.write_splits(rows, str(tmp_path), "split", "ids", "pos", 7, end)
    assert read(tmp_path) == expected([(s, i, list((t or "").encode())) for s, i, t in texts], 7, end)
