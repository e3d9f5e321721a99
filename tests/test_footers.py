import pyarrow as pa
import pyarrow.parquet as pq

from quern.operators import windows
from quern.sources import footers, readers


def long(i):
    return f"document {i} " + "x" * 30


def test_files_of_many_schemas(spark, tmp_path):
    n = iter(range(100))
    texts = lambda: [long(next(n)), "short", None, long(next(n))]
    given = {
        "a_text.parquet": {"text": texts(), "content": ["no"] * 4},
        "b_large.parquet": {"content": pa.array(texts(), pa.large_string()), "meta": [1] * 4},
        "c_dictionary.parquet": {"code": pa.array(texts()).dictionary_encode()},
        "d_key.parquet": {"body": texts(), "text": ["no"] * 4},
        "e_binary.parquet": {"text": pa.array([b"x" * 40] * 4, pa.binary()), "content": texts()},
        "f_number.parquet": {"text": [1, 2, 3, 4]},
        "g_list.parquet": {"solution": [["x" * 40]] * 4},
        "h_other.parquet": {"title": texts()},
        "i_none.parquet": {"text": pa.array([], pa.string())},
    }
    for name, columns in given.items():
        pq.write_table(pa.table(columns), tmp_path / name)
    (tmp_path / "j_broken.parquet").write_bytes(b"PAR1 is not enough")
    (tmp_path / "k_empty.parquet").write_bytes(b"")
    names = [*given, "j_broken.parquet", "k_empty.parquet", "l_missing.parquet"]
    got, plan = footers.read_mixed(spark, [str(tmp_path / x) for x in names], "body")
    rows = {(x["path"].rpartition("/")[2], x["row"], x["text"]) for x in got.collect()}
    want = {(f, i, t) for f, c in (("a_text.parquet", "text"), ("b_large.parquet", "content"), ("c_dictionary.parquet", "code"), ("d_key.parquet", "body")) for i, t in enumerate(pa.table(given[f])[c].to_pylist()) if t and len(t) > 30}
    assert rows == want and len(rows) == 8
    said = {x["path"].rpartition("/")[2][0]: (x["column"], x["reason"]) for x in plan.collect()}
    assert said == {"a": ("text", None), "b": ("content", None), "c": ("code", None), "d": ("body", None), "e": ("text", "column is not text"), "f": ("text", "column is not text"), "g": ("solution", "column is not text"), "h": (None, "no text column"), "i": ("text", None), "j": (None, "no readable footer"), "k": (None, "no readable footer"), "l": (None, "no such file")}
    assert footers.read_mixed(spark, [])[0].count() == 0


def test_a_file_that_breaks_off(spark, tmp_path):
    for i in range(2):
        pq.write_table(pa.table({"text": [long(j) for j in range(2000)]}), tmp_path / f"{i}.parquet", compression="none", use_dictionary=False)
    raw = bytearray((tmp_path / "1.parquet").read_bytes())
    raw[40:4000] = bytes(3960)
    (tmp_path / "1.parquet").write_bytes(raw)
    plan = footers.plan_files(spark, [str(tmp_path / f"{i}.parquet") for i in range(2)])
    assert [p.reason for p in plan] == [None, None]
    assert footers.read_planned(spark, plan).where("path like '%/0.parquet'").count() == 2000


def test_draws_over_all_shards(spark, tmp_path):
    import numpy as np

    sizes = [300, 0, 1, 900, 40]
    streams = [[9 if (i * 7 + k) % 23 in (0, 14) else i % 9 for i in range(n)] for k, n in enumerate(sizes)]
    shards = []
    for i, s in enumerate(streams):
        np.asarray(s, "<u2").tofile(tmp_path / f"{i}.bin")
        shards.append((str(tmp_path / f"{i}.bin"), 2 * len(s)))
    prefix, truth, reach = 6, 5, 12
    places = readers.drawn_places(spark, shards, 400, prefix + truth + reach)
    assert places.count() == 400 and {x["path"] for x in places.select("path").distinct().collect()} >= {shards[0][0], shards[3][0]}
    rows = windows.sampled_documents(readers.read_at(places, reach + prefix + truth), 9, prefix, truth, reach).collect()
    assert len(rows) == 400 and {x["outcome"] for x in rows} == {"found", "no mark", "too short", "mark in prefix"}
    for x in rows:
        s = streams[[p for p, _ in shards].index(x["path"])]
        at = next((i for i in range(x["offset"], min(x["offset"] + reach, len(s))) if s[i] == 9), None)
        if at is None:
            want = ("no mark", None, None)
        elif at + 1 + prefix + truth >= len(s):
            want = ("too short", None, None)
        elif 9 in s[at + 1 : at + 1 + prefix]:
            want = ("mark in prefix", None, None)
        else:
            want = ("found", s[at + 1 : at + 1 + prefix], s[at + 1 + prefix : at + 1 + prefix + truth])
        assert (x["outcome"], x["prefix"], x["truth"]) == want
    assert readers.drawn_places(spark, shards[:1], 5, 1000).count() == 0
