import pytest
from pyspark.sql import functions as F

from quern.functions import numbers, text
from quern.functions.running import running_total
from quern.operators import filters, sanitize


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_strip_knows_all_white_space(spark):
    wide = " \x1c\x1d\x85   　\t\n"
    df = column(spark, [wide + "a b" + wide, "​x﻿", "", None])
    assert values(df, text.strip(F.col("v"))) == ["a b", "​x﻿", "", None]


def test_word_count_and_truthiness(spark):
    df = column(spark, ["a  b c", "  ", "", "one"])
    assert values(df, text.word_count(F.col("v"))) == [3, 0, 0, 1]
    assert values(column(spark, ["", None, "x"]), text.first_truthy(F.col("v"), F.lit("y"))) == ["y", "y", "x"]


def test_lines(spark):
    texts = ["a\r\nb\n", "a\x0bb\x1cc", "", "\n\n", "x y"]
    assert values(column(spark, texts), text.lines(F.col("v"))) == [t.splitlines() for t in texts]


PREAMBLES = {
    "Sure! Here is the python code:\ndef run(): pass": "def run(): pass",
    "Certainly, here is the solution:\ndef solve(): pass": "def solve(): pass",
    "Here's the code:\ndef test(): pass": "def test(): pass",
    "Alright, below is the implementation:\nclass Node: pass": "class Node: pass",
    "Here is a: Sure, he said: code": "he said: code",
    "": "",
}
POSTAMBLES = {f"def run(): pass\n{end}": "def run(): pass" for end in ("Hope this helps!", "Let me know if you have any questions.", "Happy coding!", "Good luck!")} | {"say: hope this helps you": "say:", "Good luck\nx": "Good luck\nx"}


def test_preambles_and_postambles(spark):
    df = column(spark, list(PREAMBLES))
    got = dict(zip(PREAMBLES, values(df, sanitize.without_preamble(F.col("v"))), strict=True))
    assert got["Alright, below is the implementation:\nclass Node: pass"] == "class Node: pass"
    assert got == PREAMBLES
    assert values(column(spark, list(POSTAMBLES)), sanitize.without_postamble(F.col("v"))) == list(POSTAMBLES.values())


def test_python_predicate(spark):
    code = ["def add(a: int, b: int) -> int:\n    return a + b", "def add(a, b)\n    return", "", "  ", 'pattern = "\\c"', 'pattern = r"\\c"', None, "x\x00"]
    assert values(column(spark, code), filters.parses_as_python(F.col("v"))) == [True, False, False, False, False, True, False, False]


def test_snippets_and_gate(spark):
    df = column(spark, ["say\n```python\nx = 1\n```", "```\ny = 2\n```", "z = 3", "only prose here", "```python\nx = = 1\n```"])
    got = filters.python_snippet(df, "v")
    assert values(got, "snippet") == ["x = 1", "y = 2", "z = 3", None, "x = = 1"]
    assert [r.i for r in filters.code_gate(df, "v").orderBy("i").collect()] == [0, 1, 2, 3]


def test_sizes(spark):
    df = column(spark, ["70M", "1.2b", " 350 m ", "12", "x", "", "1.2T"])
    assert values(df, numbers.parse_size(F.col("v"))) == [70_000_000, 1_200_000_000, 350_000_000, 12, None, None, None]
    assert values(df, numbers.parse_tokens(F.col("v")))[-1] == 1_200_000_000_000
    sizes = column(spark, [71_456_832, 1_200_000_000, 2_000_000_000, 999, 1500], "long")
    assert values(sizes, numbers.format_size(F.col("v"))) == ["71M", "1.2B", "2B", "999", "2K"]


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_running_total_is_the_plain_one(spark, bucket):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g"))
    rows = running_total(df, "v", ["id"], F.floor(F.col("id") / bucket), "s", ["g"]).collect()
    for r in rows:
        assert r["s"] == sum(i % 7 for i in range(r["id"] + 1) if i % 2 == r["g"])
