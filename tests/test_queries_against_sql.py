"""Queries against their own SQL on small tables with values that the driver's small tables lack."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.plans import catalog, files, storage  # noqa: F401


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for key, rows in tables.items():
        path = str(folder / f"{key}.parquet")
        pq.write_table(rows, path)
        con.execute(f"CREATE VIEW {key} AS SELECT * FROM '{path}'")
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    return sorted(got), sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["eval_chunks", "random_windows", "rank_blocks", "sliding_windows", "tiled_stream"])
def test_streams_of_hundredths(spark, tmp_path, name):
    # Of floats, 100 * 0.29 is 29, though the float nearest to 0.29 is less than that.
    vectors = [[((i * 7 + j) % 401 - 200) / 100 for j in range(64)] for i in range(40)]
    rows = pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 40, pa.int32())})
    got, wanted = against_sql(spark, tmp_path, name, embeddings=rows)
    assert got == wanted


def test_windows_of_events_in_whole_milliseconds(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    late = [start + dt.timedelta(minutes=10 * k, microseconds=us) for k in range(1, 9) for us in (-1, -400, -500, -501, -600, 0, 499, 500, 1500)]
    times = [*late, start + dt.timedelta(hours=2, minutes=20, microseconds=-500)]
    events = pa.table({"event_id": pa.array(range(len(times)), pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "event_type": [f"t{i % 2}" for i in range(len(times))]})
    got, wanted = against_sql(spark, tmp_path, "stream_windows", events=events)
    assert got == wanted and wanted


@pytest.mark.parametrize("name", ["architecture_search", "model_plans"])
def test_model_sizes_keep_their_candidates_in_one_row(spark, tmp_path, name):
    keys = [0, -57, -500, 1, 2, 3, 500, 5_000, 30_000, 200_000]
    part = pa.table({"p_partkey": pa.array([*keys, 1, 2], pa.int64())})
    got, wanted = against_sql(spark, tmp_path, name, part=part)
    assert got == sorted(set(wanted)) and len(got) == len(keys)
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan
