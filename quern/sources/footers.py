"""Parquet files whose schemas differ, read as one corpus: planned from footers, then one scan for each text column.

The plan has a row a file, as Spark's own file index has, so its size goes with the number of files, not of documents.
Footers are read through Spark's file systems, ``threads`` at a time.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.operators.filters import TEXT_COLUMNS, min_length

PLAN = "path string, column string, reason string"


class Planned(NamedTuple):
    """A file with the column that is read from it, or the reason why it is skipped."""

    path: str
    column: str | None
    reason: str | None


def _planned(spark: SparkSession, path: str, names: tuple[str, ...]) -> Planned:
    jvm = spark._jvm
    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, spark._jsc.hadoopConfiguration()))
        try:
            schema = reader.getFileMetaData().getSchema()
            column = next((n for n in names if schema.containsField(n)), None)
            field = schema.getType(column) if column else None
            kind = field.toString() if field is not None else ""
        finally:
            reader.close()
    except Py4JJavaError as e:
        cause = e.java_exception.getClass().getSimpleName()
        return Planned(path, None, "no such file" if cause == "FileNotFoundException" else "no readable footer")
    if column is None:
        return Planned(path, None, "no text column")
    # As Parquet writes it down: optional binary text (STRING).
    if not kind.startswith(("optional binary ", "required binary ")) or "(STRING)" not in kind:
        return Planned(path, column, "column is not text")
    return Planned(path, column, None)


def plan_files(spark: SparkSession, paths: list[str], key: str | None = None, names: tuple[str, ...] = TEXT_COLUMNS, threads: int = 32) -> list[Planned]:
    """What to read of each file: the named column, else the first known one that it has; one that holds no text is skipped."""
    wanted = ((key,) if key else ()) + names
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda p: _planned(spark, p, wanted), paths))


def read_planned(spark: SparkSession, plan: list[Planned], skip_bad_pages: bool = True) -> DataFrame:
    """path, row, text of the files of a plan, by position; only their text columns are scanned.

    A file that breaks off is read up to there unless skip_bad_pages is off, which stops the read.
    """
    out = spark.createDataFrame([], "path string, row long, text string")
    for column in sorted({p.column for p in plan if not p.reason}):
        paths = [p.path for p in plan if p.column == column and not p.reason]
        scan = spark.read.schema(StructType([StructField(column, StringType())])).option("ignoreCorruptFiles", str(skip_bad_pages).lower()).parquet(*paths)
        out = out.unionByName(scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(f"`{column}`").alias("text")))
    return out


def read_mixed(spark: SparkSession, paths: list[str], key: str | None = None, skip_bad_pages: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, row, text) of documents longer than 30 characters, and (path, column, reason) of the files, reason null if read."""
    plan = plan_files(spark, paths, key)
    return min_length(read_planned(spark, plan, skip_bad_pages)), spark.createDataFrame(plan, PLAN)
