"""Fill-in-the-middle rewriting of documents over run-length classes of their characters (operator 13).

A text is stored as maximal runs of one character class with the number of units that have ended by the end of each run.
Inside a run units end at a fixed stride, or once at the run's end, so a cut after k units is one binary search for its run
and one multiplication, whatever the text's length:

- ``line``: a unit is ``[^\\n]*\\n`` or the rest of the text. Classes are line ends (each ends a unit) and all else.
- ``word``: a unit is a word with the white space after it. Classes are ``[\\x20\\x09-\\x0D]`` (a run ends a unit) and all else.
- ``char``: a unit is a code point. Classes are the widths of code points in UTF-8 (each code point ends a unit).

Two cuts and the form of a document come from SHA-256 of the seed and its doc_id, so reruns agree. ``psm`` puts the prefix
first, ``spm`` the suffix; ``restored`` gives the text back from either.

Defined results: a null text is an empty one. Empty texts and those that hold a sentinel stay plain, as does what ``rate``
leaves out. A null doc_id is hashed as the word null. Rows are independent, so ties and repeated rows need no rule and give
equal results; extra columns are ignored; an empty table gives an empty result. A text's runs take 12 bytes each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, bounded_batches, buffers, docs_of

#: Marks of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: Bytes of a code point by its first one; 0 for the others.
_WIDTH = np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.uint8)


class Runs:
    """The runs of a text: where each starts, how many units end up to its end, and their stride (0: one at its end)."""

    def __init__(self, data: np.ndarray, unit: str) -> None:
        self.size = len(data)
        if unit == "char":
            at = np.flatnonzero(_WIDTH[data])
            cls = _WIDTH[data[at]]
        else:
            at = None
            cls = data == 10 if unit == "line" else _SPACE[data]
        cut = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, np.int64)
        many = np.diff(np.r_[cut, len(cls)])
        kind = cls[cut]
        if unit == "char":
            self.start, self.stride, ends = at[cut], kind, many
        else:
            self.start, self.stride = cut, (kind & (unit == "line")).astype(np.uint8)
            ends = np.where(kind, many if unit == "line" else 1, 0)
            if len(ends) and not kind[-1]:
                ends[-1] = 1  # the text ends inside a unit
        self.upto = np.cumsum(ends)

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def offset(self, k: int) -> int:
        """The byte after the k-th unit."""
        if k == 0:
            return 0
        i = int(np.searchsorted(self.upto, k))
        before = int(self.upto[i - 1]) if i else 0
        if self.stride[i]:
            return int(self.start[i]) + (k - before) * int(self.stride[i])
        return int(self.start[i + 1]) if i + 1 < len(self.start) else self.size


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero(_WIDTH[data]))


def _rows(unit: str, rate: int, spm: int, seed: int, sentinels: tuple[str, str, str]):
    marks = p, s, m = [x.encode() for x in sentinels]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            n, form, before, between, out = [], [], [], [], []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = data[at[i] : at[i + 1]]
                raw = text.tobytes()
                runs = Runs(text, unit)
                h1, h2, h3, h4 = draws(doc_id, seed)
                n.append(runs.units)
                if not raw or h3 % 100 >= rate or any(x in raw for x in marks):
                    form.append("plain")
                    before.append(None)
                    between.append(None)
                    out.append(raw)
                    continue
                a, b = (runs.offset(k) for k in sorted((h1 % (runs.units + 1), h2 % (runs.units + 1))))
                before.append(_code_points(text[:a]))
                between.append(_code_points(text[a:b]))
                form.append("spm" if h4 % 100 < spm else "psm")
                out.append(s + raw[b:] + p + raw[:a] + m + raw[a:b] if form[-1] == "spm" else p + raw[:a] + s + raw[b:] + m + raw[a:b])
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rewrite


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can't come about where a text and a sentinel meet: none holds the first character of any later on."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(x[0] in y[1:] for x in sentinels for y in sentinels):
        raise ValueError("sentinels must differ, and their first characters must not occur inside them")
    return sentinels


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    rate: percent of documents that are rewritten; spm: percent of those whose suffix comes first.
    """
    if unit not in ("line", "word", "char"):
        raise ValueError("unit must be line, word or char")
    bounded_batches(docs.sparkSession)
    return docs_of(docs, "doc_id", "text").mapInArrow(_rows(unit, rate, spm, seed, _checked(sentinels)), SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.escape(x) for x in _checked(sentinels)), -1)
    prefix, suffix = (F.when(form == "psm", F.get(parts, F.lit(a))).otherwise(F.get(parts, F.lit(3 - a))) for a in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def fim_digest(rewritten: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with digests of the output and of the text rebuilt from it in their place."""
    return rewritten.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
