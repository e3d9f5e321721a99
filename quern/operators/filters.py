"""Row filters and predicates of the readers: minimum length, code quality, payload detection, syntax."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quern.functions.text import contains_any, first_truthy, is_blank, strip

#: What a code file must and may not contain.
LOOPS = ("for ", "while ", "if ")
BANNED = ("django.db", "rest_framework", "boto3", "flask", "conftest", "alembic", "Auto-generated", "protobuf", "setup(", "argparse")
TEXT_COLUMNS = ("text", "content", "code", "solution")


def pick_text_column(df: DataFrame, key: str | None = None, names: tuple[str, ...] = TEXT_COLUMNS) -> str:
    """The named column, else the first known one; decided from the schema."""
    for name in ((key,) if key else ()) + names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} among {df.columns}")


def min_length(df: DataFrame, text: str = "text", more_than: int = 30) -> DataFrame:
    """Rows whose text without outer white space is longer than that; the text itself stays as it is."""
    return df.where(F.length(strip(F.col(text))) > more_than)


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def code_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Code files of a fair length that define something, branch or loop, and aren't boilerplate; stripped."""
    code = F.col(text)
    kept = df.where(F.length(code).between(200, 25000) & F.contains(code, F.lit("def ")) & contains_any(code, LOOPS) & ~contains_any(code, BANNED))
    return kept.withColumn(text, strip(code))


def looks_like_hash(text: Column) -> Column:
    """A payload of 40 characters without any sign of code is an identifier, not content."""
    return (F.length(text) == 40) & ~contains_any(text, ("def ", "import ", "class ", "="))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(~is_blank(c), c) for c in columns])


@F.pandas_udf(BooleanType())
def parses_as_python(code: pd.Series) -> pd.Series:
    """Whether a text is Python without syntax warnings; what can't be parsed at all (too deep, null bytes) isn't."""

    def good(text: str | None) -> bool:
        if not text or not text.strip():
            return False
        with warnings.catch_warnings():
            warnings.simplefilter("error", SyntaxWarning)
            try:
                ast.parse(text)
            except (SyntaxError, SyntaxWarning, ValueError, RecursionError, MemoryError):
                return False
        return True

    return code.map(good, na_action=None)


def fenced_snippet(text: Column) -> Column:
    """The first fenced block (python or bare) that isn't blank; null if there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```(?:python)?\s*\n(.*?)```"), F.lit(1))
    return F.get(F.filter(blocks, lambda b: ~is_blank(b)), F.lit(0))


def python_snippet(df: DataFrame, text: str, out: str = "snippet") -> DataFrame:
    """Adds the fenced block, else the whole text if it parses, else null."""
    fenced = fenced_snippet(F.col(text))
    return df.withColumn(out, F.coalesce(strip(fenced), F.when(parses_as_python(F.col(text)), strip(F.col(text)))))


def code_gate(df: DataFrame, text: str) -> DataFrame:
    """Drops a row only if it has a snippet and that doesn't parse."""
    return python_snippet(df, text, "_snippet").where(F.col("_snippet").isNull() | parses_as_python(F.col("_snippet"))).drop("_snippet")


def code_body(text: Column) -> Column:
    """What stands before the first fence."""
    return F.substring_index(text, "```", 1)


def rendered_reasoning(problem: Column, solution: Column, think: bool = False) -> Column:
    """Problem and solution in one text; null if either is blank. think wraps a solution that has no tags."""
    p, s = strip(problem), strip(solution)
    wrapped = F.when(F.contains(s, F.lit("<think>")), s).otherwise(F.concat(F.lit("<think>\n"), s, F.lit("\n</think>"))) if think else s
    return F.when((p != "") & (s != ""), F.concat(F.lit("Problem:\n"), p, F.lit("\n\nSolution:\n"), wrapped))


#: Fixed value: the opening thought of a solution without tags.
OPENING_THOUGHT = "<think>\nAnalyze the problem and solve systematically.\n</think>\n"


def with_think(solution: Column) -> Column:
    """A solution without tags gets a short opening thought."""
    return F.when(F.contains(solution, F.lit("<think>")), solution).otherwise(F.concat(F.lit(OPENING_THOUGHT), solution))


def prompt_of(*names: str) -> Column:
    """First truthy of some columns, stripped afterwards."""
    return strip(first_truthy(*[F.col(n) for n in names]))
