"""Quality classifier by compression (operator 7).

Two zstandard dictionaries are built, one from texts labelled good, one from texts labelled bad. A text is compressed with
each, in consecutive pieces of ``PIECE_BYTES``, so that every part of a text of any length is held against the dictionary
rather than against the text's own beginning; the difference of the two sums of compressed sizes, divided by the text's
own size, says which it resembles. A logistic curve over
that difference, fitted on training texts that are in neither dictionary, makes it a probability.

Training reads at most ``MOST_TRAIN`` labelled texts of each class, those with the smallest hash of doc_id. Spark tasks cut
what the driver gets of each: stretches of whole ``STRETCH`` bytes spread evenly from its first to its last byte for the
dictionaries, and its difference for the curve, so a long text is neither read to the driver nor judged by its beginning. Everything else (scores) reads whole texts in
Spark tasks, and the two dictionaries (at most ``DICT_BYTES`` each) go along with the task.

Defined results: a null text is an empty one and gets the share of good labels in training; so do all texts if either
class is missing in training (0.5 without any label). A document with labels of both kinds trains as neither. Null
labels and null ids don't train; a null doc_id isn't held out. Extra columns are ignored; repeated rows score alike; an
empty table gives an empty result.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, cut_lineage, docs_of

MOST_TRAIN = 1500
STRETCH = 512
#: Bytes of a dictionary that one text may give: a text of up to this size goes whole.
MOST_OF_TEXT = 16 << 10
DICT_BYTES = 2 << 20
LEVEL = 6
PIECE_BYTES = 16 << 10


def held_out() -> Column:
    """crc32 of doc_id as text modulo 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class CompressionModel:
    """Dictionaries of both classes and the curve: p = 1 / (1 + exp(-(slope * difference + shift)))."""

    good: bytes
    bad: bytes
    slope: float
    shift: float
    prior: float

    def difference(self, texts: list[bytes]) -> list[float]:
        """(bad size - good size) / (text size + 1) of each text."""
        if not hasattr(self, "_tools"):
            self._tools = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
            for tool, d in zip(self._tools, (self.good, self.bad), strict=True):
                tool.compress(b"")
        good, bad = self._tools
        out = []
        for text in texts:
            pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
            out.append(sum(len(bad.compress(x)) - len(good.compress(x)) for x in pieces) / (len(text) + 1))
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        if not self.good or not self.bad:
            return [self.prior] * len(texts)
        return [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.shift)))) if t else self.prior for t, x in zip(texts, self.difference(texts), strict=True)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}


def spread(text: bytes, most: int) -> bytes:
    """At most ``most`` bytes of a text: all of it, or stretches spread evenly from its beginning to its end."""
    n = max(1, most // STRETCH)
    if len(text) <= n * STRETCH:
        return text[:most] if len(text) > most else text
    starts = np.linspace(0, len(text) - STRETCH, n).astype(np.int64)
    return b"\n".join(text[x : x + STRETCH] for x in starts.tolist())


def _dictionary(texts: list[bytes]) -> bytes:
    """An equal share of every text, so that the dictionary covers all of them."""
    share = max(STRETCH, DICT_BYTES // max(1, len(texts)))
    return b"\n".join(spread(t, share) for t in texts)[-DICT_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps; rows weigh as they are, so scores are shares of good texts."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.full(len(y), 1.0 / len(y))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-4 * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _spread_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [spread(t.as_py().encode("utf-8", "surrogatepass"), MOST_OF_TEXT) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(texts, pa.binary())], ["doc_id", "quality", "text"])


def _difference_with(model: CompressionModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.difference([t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.float64())], ["doc_id", "quality", "x"])

    return rows


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAIN) -> CompressionModel:
    """The model from labels of documents that aren't held out."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").where(~held_out())
    labelled = {r["low"]: r["count"] for r in marks.groupBy("low").count().collect()}
    prior = labelled.get(1, 0) / sum(labelled.values()) if labelled else 0.5
    chosen = None
    for value in (0, 1):  # most texts of a class at most, so what is collected below is bounded
        part = marks.where(F.col("low") == value).select("doc_id", F.col("low").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs_of(docs, "doc_id", "text").where("text is not null and text <> ''").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = cut_lineage(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    got = rows.mapInArrow(_spread_rows, "doc_id long, quality int, text binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most).collect()
    by = {v: [(r["doc_id"], bytes(r["text"])) for r in got if r["quality"] == v] for v in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        return CompressionModel(b"", b"", 0.0, 0.0, prior)
    cut = {v: max(1, len(by[v]) * 2 // 3) for v in (0, 1)}
    model = CompressionModel(*(_dictionary([t for _, t in by[v][: cut[v]]]) for v in (1, 0)), 1.0, 0.0, prior)
    # The curve is fitted to texts that are in neither dictionary, in the classes' own proportion.
    rest = {i for v in (0, 1) for i, _ in by[v][cut[v] :]}
    points = rows.where(F.col("doc_id").isin(rest)).mapInArrow(_difference_with(model), "doc_id long, quality int, x double").orderBy("doc_id").collect()
    y = np.array([r["quality"] for r in points], dtype=float)
    model.slope, model.shift = _curve(np.array([r["x"] for r in points]), y)
    # Both classes give as many texts at most, so the curve's odds are set to those of all labels.
    model.shift += math.log(prior / (1 - prior)) - math.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5))
    return model


def _score_with(model: CompressionModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs_of(docs, "doc_id", "text").withColumn("held_out", held_out())
    return rows.mapInArrow(_score_with(train(docs, labels, most)), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAIN) -> DataFrame:
    """docs without the rows that are predicted bad; all columns stay, and no shuffle is needed."""
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, most)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: model.scores([t.encode("utf-8", "surrogatepass")])[0] >= 0.5)

    return docs.where(good(F.col("text")))
