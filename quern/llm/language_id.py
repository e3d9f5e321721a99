"""Hierarchical language identification (operator 9).

A linear model predicts the language family first; inside the family, one linear support vector machine for each pair of
its languages votes. Features are hashed byte n-grams (2 to 4) of the lower-cased letters of the whole text, counted,
square-rooted and scaled to length one. Languages outside ``FAMILIES`` are a family of their own each.

Training reads at most ``MOST_TRAIN`` documents of each language, those with the smallest hash of doc_id. Their features are
taken from whole texts in Spark tasks and come to the driver as the hashed n-grams that occur (``DIMS`` at most), so what
it holds is bounded by the number of languages; each machine is fitted on the rows of its own languages. Predictions read whole texts in Spark tasks; the
weights that go along are ``DIMS`` numbers for each family and pair.

Defined results: ``und`` with score 0.0 where the text is null or has no letter, and for every text if nothing was learned.
With one learned language all other texts get it, score 1.0. Null ids don't train and aren't held out. Ties go to the
language that comes first by name. Extra columns are ignored; repeated rows are predicted alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, docs_of, written
from quern.llm.quality import held_out

#: Families of languages.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
DIMS = 1 << 12
ORDERS = (2, 3, 4)
MOST_TRAIN = 600
#: Rows on which one family's machine is fitted.
MOST_FAMILY = 6000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes of lower-cased text that aren't letters become a space; those over 127 are parts of letters here.
_CLEAN = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PIECE = 1 << 20


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams over the whole text, square-rooted, length one; pieces bound the memory."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()) + b" "
    counts = np.zeros(DIMS)
    for a in range(0, len(data), PIECE):
        raw = np.frombuffer(data, np.uint8)[a : a + PIECE + max(ORDERS) - 1].astype(np.uint32)
        for n in ORDERS:
            m = min(len(raw) - n + 1, PIECE)
            if m > 0:
                code = np.full(m, n, np.uint32)
                for i in range(n):
                    code = code * np.uint32(257) + raw[i : i + m]
                code ^= code >> np.uint32(15)
                code *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(code >> np.uint32(20), minlength=DIMS)
    counts = np.sqrt(counts)
    size = np.linalg.norm(counts)
    return counts / size if size else counts


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + cost * mean of squared hinge losses; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    bound = 1 + 2 * cost * 2.0  # rows have length sqrt(2), weights sum to one
    momentum = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - (v - 2 * cost * (z.T @ (weight * slack * y))) / bound
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


@dataclass
class LanguageModel:
    languages: list[str]
    families: dict[str, str]
    family_weights: dict[str, np.ndarray] = field(default_factory=dict)  # one against the rest
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), 1.0)
        family, sure = next(iter(self.families.values())), 1.0
        if self.family_weights:
            margins = {f: float(w @ x) for f, w in self.family_weights.items()}
            family = max(sorted(margins), key=margins.get)
            other = max((m for f, m in margins.items() if f != family), default=-1.0)
            sure = 1 / (1 + np.exp(-2 * (margins[family] - other)))
        inside = [lang for lang in self.languages if self.families[lang] == family]
        votes, margin = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
        for a, b in combinations(inside, 2):
            m = float(self.pair_weights[a, b] @ x)
            votes[a if m > 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = max(inside, key=lambda k: (votes[k], margin[k]))
        if len(inside) > 1:
            sure /= 1 + np.exp(-4 * margin[best] / (len(inside) - 1))
        return best, float(sure)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], families: dict[str, str] = FAMILIES) -> LanguageModel:
    """The model of rows (n-grams that occur, their weights, language)."""
    languages = sorted({lang for _, _, lang in rows})
    own = {lang: families.get(lang, lang) for lang in languages}
    model = LanguageModel(languages, own)
    if len(languages) < 2:
        return model

    def machine(some: list, left: set[str]) -> np.ndarray:
        x = np.zeros((len(some), DIMS), np.float32)
        for i, (at, weight, _) in enumerate(some):
            x[i, at] = weight
        return linear_svm(x, np.array([1.0 if lang in left else -1.0 for _, _, lang in some]))

    if len(kinds := sorted(set(own.values()))) > 1:
        # Of each language an equal share, so the rows of one machine stay bounded whatever the number of languages.
        share = max(20, MOST_FAMILY // len(languages))
        some = [r for lang in languages for r in [x for x in rows if x[2] == lang][:share]]
        model.family_weights = {f: machine(some, {k for k in languages if own[k] == f}) for f in kinds}
    for f in kinds:
        for a, b in combinations([k for k in languages if own[k] == f], 2):
            model.pair_weights[a, b] = machine([r for r in rows if r[2] in (a, b)], {a})
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, weight = [], []
        for text in batch.column("text"):
            x = features(text.as_py()) if LETTER.search(text.as_py()) else np.zeros(0)
            at.append(np.flatnonzero(x).astype(np.int32))
            weight.append(x[at[-1]].astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "weight"])


def _sparse_rows(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """What fit() reads of the rows above, as views of the Arrow columns rather than Python numbers."""
    for batch in table.to_batches():
        at, weight = batch.column("at"), batch.column("weight")
        ends, values, sizes = at.offsets.to_numpy(), at.values.to_numpy(), weight.values.to_numpy()
        first = weight.offsets.to_numpy()
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            yield values[ends[i] : ends[i + 1]], sizes[first[i] : first[i + 1]], lang


def train(docs: DataFrame, most: int = MOST_TRAIN) -> LanguageModel:
    """The model from the documents that aren't held out and have a language."""
    rows = docs_of(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    keys = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    # Per language as many hash ranges as it has rows, so that the lowest one or two hold enough: no list of all partitions' rows.
    sizes = written(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    limit = F.least(F.lit(float(1 << 63)), F.lit(float(1 << 63)) * 4 * most / F.col("n") - F.lit(float(1 << 62)) * 2)
    near = keys.join(F.broadcast(sizes), "lang").where((F.col("n") <= 2 * most) | (F.col("h").cast("double") < limit))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= most).select("lang", "doc_id").distinct()
    got = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = got.mapInArrow(_feature_rows, "doc_id long, lang string, at array<int>, weight array<float>").where("size(at) > 0").orderBy("doc_id", "lang").toArrow()
    return fit(list(_sparse_rows(got)))


def _predict_with(model: LanguageModel):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([k for k, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def language_scores(docs: DataFrame, most: int = MOST_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs_of(docs, "doc_id", "text").withColumn("held_out", held_out())
    return rows.mapInArrow(_predict_with(train(docs, most)), "doc_id long, held_out boolean, lang_pred string, score double")
