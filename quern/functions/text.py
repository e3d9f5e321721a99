"""Column helpers with the exact white-space and emptiness rules of the corpus operators; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


#: The same class as characters, for the trim functions, which are much faster than a pattern.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space at both ends (all of Unicode's, not only the space)."""
    return F.btrim(text, F.lit(SPACES))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def word_count(text: Column) -> Column:
    """Number of pieces between runs of white space."""
    return F.size(F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")).cast("long")


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def contains_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: every Unicode line end, no empty last piece."""
    pieces = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
