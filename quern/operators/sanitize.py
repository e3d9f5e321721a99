"""Removal of chatty openings and endings from technical answers, repeated until nothing changes."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import SPACE, strip

#: Patterns in the order in which they apply.
PREAMBLES = (
    r"^(?:Sure|Certainly|Of course|Here is|Here's|Below is|Here are)[^:\n]*:\s*",
    r"^(?:Sure|Certainly|Of course|I'd be happy to help|Alright)[,!\.]\s*",
    r"^(?:Here is the python code|Here is the code|Here is the solution)[^:\n]*:\s*",
)
POSTAMBLES = (
    r"\n*(?:Hope this helps|Let me know if you have any questions|Let me know if you need anything else|Feel free to ask)[^.\n]*\.?$",
    r"\n*(?:Happy coding|Good luck)[\.!]*$",
)
#: Words of which every opening and ending holds one.
MARKS = r"(?iu)Sure|Certainly|Of course|Here is|Here's|Below is|Here are|I'd be happy to help|Alright|Hope this helps|Let me know if you|Feel free to ask|Happy coding|Good luck"


def _java(pattern: str) -> str:
    pattern = pattern.removesuffix("$") + r"\z" if pattern.endswith("$") else pattern
    return "(?iuU)" + pattern.replace(r"\s", SPACE)


def _round(text: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        text = strip(F.regexp_replace(text, _java(p), ""))
    return text


def _settled(text: Column, patterns: tuple[str, ...]) -> Column:
    fits = lambda t: functools.reduce(lambda a, b: a | b, [t.rlike(_java(p)) for p in patterns])
    # Each round removes one mark at least, so there are as many rounds as marks at most; the first that changes nothing is
    # the last that looks at the text.
    most = F.regexp_count(text, F.lit(MARKS)) + 1
    first = F.struct(strip(text).alias("text"), F.lit(True).alias("goes_on"))
    again = lambda acc: F.struct(_round(acc["text"], patterns).alias("text"), F.lit(True).alias("goes_on"))
    over = lambda acc: F.struct(acc["text"].alias("text"), F.lit(False).alias("goes_on"))
    step = lambda acc, _: F.when(~acc["goes_on"], acc).when(fits(acc["text"]), again(acc)).otherwise(over(acc))
    return F.when(fits(strip(text)), F.aggregate(F.sequence(F.lit(1), most), first, step)["text"]).otherwise(strip(text))


def without_preamble(text: Column) -> Column:
    """Without openings such as 'Sure! Here is the code:'."""
    return _settled(text, PREAMBLES)


def without_postamble(text: Column) -> Column:
    """Without endings such as 'Hope this helps!'; they may begin inside a line."""
    return _settled(text, POSTAMBLES)


def clean_completion(text: Column) -> Column:
    """A generated turn: up to its end mark, without document ends, stripped."""
    return strip(F.replace(F.substring_index(text, "<|im_end|>", 1), F.lit("<|endoftext|>"), F.lit("")))
