"""Python workers hold the tokens of a slice, not of a batch."""

import pyarrow as pa

from quern.operators import tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_batches_are_worked_on_in_slices():
    texts = ["a" * 70_000, None, "", "b" * tokens.SLICE_BYTES * 2, *["c" * 30_000] * 60]
    for values in (pa.array(texts), pa.array([None if t is None else [1] * len(t) for t in texts], pa.list_(pa.int32()))):
        parts = list(tokens._slices(pa.RecordBatch.from_arrays([values, pa.array(range(len(texts)))], ["v", "i"]), "v"))
        assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
        assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column("v").to_pylist()) <= tokens.SLICE_BYTES for p in parts)
    assert list(tokens._slices(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["v"]), "v")) == []


def test_round_trip_keeps_nulls_empty_texts_and_other_columns(spark):
    texts = ["", None, "a <|im_end|> b", "\U0001f600é\u0000", "word " * 9000, " "]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, other int")
    coded = tokens.encode(rows, VOCABULARY)
    assert coded.columns == ["doc_id", "text", "other", "ids"] and {r["ids"][-1] for r in coded.collect()} == {tokens.END_OF_TEXT}
    back = tokens.decode(coded.selectExpr("doc_id", "slice(ids, 1, size(ids) - 1) ids"), VOCABULARY)
    assert dict(back.select("doc_id", "text").collect()) == {i: t or "" for i, t in enumerate(texts)}
    lengths = {r["doc_id"]: r["n"] for r in tokens.token_lengths(rows, VOCABULARY).collect()}
    assert lengths == {r["doc_id"]: len(r["ids"]) for r in coded.collect()}
    gone = spark.createDataFrame([(0, None), (1, [])], "doc_id long, ids array<int>")
    assert dict(tokens.decode(gone, VOCABULARY).select("doc_id", "text").collect()) == {0: None, 1: ""}
