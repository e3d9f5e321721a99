"""The corpus pipeline: STAGES in order, each reading what its predecessor wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
the last returns what the mix takes of each remaining document: doc_id, size, source_size, target, taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, near_dup, quality, source_mix
from quern.llm.common import remove, tables, written
from quern.llm.queries import table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By session, the tables that the last stage has made for itself.
_own: dict[int, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """The stage, which first removes its predecessor's own tables: what that returned has been written and reread by now."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        there = tables(spark)
        remove(spark, [p for p in _own.pop(id(spark), []) if p in there])
        there = tables(spark)
        out = stage(spark, docs, sf_dir)
        _own[id(spark)] = [p for p in tables(spark) if p not in there]
        return out

    return run_stage


@tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@tidy
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.one_copy(docs)


@tidy
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.one_near_copy(docs)


@tidy
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of the benchmark."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources takes of each document."""
    return source_mix.source_mix(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", benchmark_stage), ("mixing sources", mix_stage)]

#: A trained classifier and hashed candidate search have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on the documents of sf_dir, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
