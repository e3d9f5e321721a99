"""Sizes and token counts written with suffixes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and their factors.
SUFFIXES = {"": 1.0, "K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def _scaled(number: Column, suffix: Column, allowed: str) -> Column:
    factor = F.lit(1.0)
    for s in allowed:
        factor = F.when(suffix == s, F.lit(SUFFIXES[s])).otherwise(factor)
    return (number.try_cast("double") * factor).cast("long")


def parse_size(text: Column) -> Column:
    """'1.2B' is 1200000000; null where the form is wrong."""
    s = F.upper(F.trim(text))
    form = r"^([0-9.]+)\s*([KMB])?$"
    return F.when(s.rlike(form), _scaled(F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2), "KMB"))


def parse_tokens(text: Column) -> Column:
    """'10_000' or '2.5T'; null and empty texts are null."""
    s = F.replace(F.upper(F.trim(text)), F.lit("_"), F.lit(""))
    form = r"^([0-9.]+)\s*([KMBT])?$"
    return F.when(s.rlike(form), _scaled(F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2), "KMBT"))


def format_size(count: Column) -> Column:
    """71456832 is '71M', 1200000000 is '1.2B'."""
    billions = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.bround(count / 1e9, 2)), r"0+$", ""), r"\.$", "")
    return (
        F.when(count >= 1_000_000_000, F.concat(billions, F.lit("B")))
        .when(count >= 1_000_000, F.concat(F.bround(count / 1e6).cast("long").cast("string"), F.lit("M")))
        .when(count >= 1_000, F.concat(F.bround(count / 1e3).cast("long").cast("string"), F.lit("K")))
        .otherwise(count.cast("string"))
    )


def size_tag(tokens: Column) -> Column:
    """The size class of a corpus."""
    return F.when(tokens < 10**9, "n<1B").when(tokens < 10**10, "1B<n<10B").when(tokens < 10**11, "10B<n<100B").otherwise("n>100B")


def base_name(repo: Column) -> Column:
    """A repository's name without its stage."""
    return F.regexp_replace(repo, r"-(base|sft|dpo)$", "")
