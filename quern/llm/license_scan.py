"""License scan by sentence rules (operator 1), in DataFrame functions only.

A text is split into sentences; each is normalised (lower case, letters, digits and dots between digits; the rest is one
space) and looked up among known licence sentences. A line is a sentence, and so are lines that follow one another without
a terminator or a blank line between them, so sentences are found however they are wrapped; comment leaders (``*``, ``#``,
``//``) are no words. The names of an SPDX expression are a sentence each, and a holder's name in the sentences of BSD
licences may be any. The identifiers found, in text order, are matched against ordered
rules: a rule is a sequence of identifiers that must follow one another among the identifiers found. Rules are tried in
their order, longer ones first, and a match takes its identifiers away from later rules.

Defined results: null and empty texts have no sentence and no licence. Rows are independent, so ties, repeated rows and
null ids need no rule; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, as written, and their identifiers.
SENTENCES = {
    "Released under the MIT License.": "mit-notice",
    "This project is licensed under the MIT License.": "mit-notice",
    "Licensed under the MIT License.": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit-condition",
    "Licensed under the Apache License, Version 2.0.": "apache2-notice",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache2-notice",
    "You may not use this file except in compliance with the License.": "apache2-compliance",
    "You may obtain a copy of the License at": "apache2-copy",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3-notice",
    "This program is free software": "gpl-free",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3-grant",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl-grant",
    "either version 2 of the License, or (at your option) any later version.": "version2-later",
    "either version 2.1 of the License, or (at your option) any later version.": "version2.1-later",
    "either version 3 of the License, or (at your option) any later version.": "version3-later",
    "This library is free software": "lgpl-free",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl-grant",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl3-grant",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl3-grant",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2-notice",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-notice",
    "This is free and unencumbered software released into the public domain.": "unlicense-notice",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.": "cc0-grant",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl2-notice",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-warranty",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4-notice",
    "This work is licensed under CC BY 4.0.": "cc-by-4-notice",
    "Licensed under CC BY 4.0.": "cc-by-4-notice",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-4-notice",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-endorse",
    "All rights reserved.": "all-rights-reserved",
}
#: Licence names of SPDX tags; a tag is a sentence of its own.
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "BSL-1.0", "Unlicense", "CC0-1.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
#: Names that SPDX has given up, and what they stand for.
OLD_SPDX = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
SENTENCES |= {f"SPDX License Identifier {name}": f"spdx-{name}" for name in (*SPDX, *OLD_SPDX)}
#: Ordered rules, each a licence and the identifiers that must follow one another; longer ones come first.
RULES = (
    # A reservation before a licence that grants rights says nothing of its own.
    ("BSD-3-Clause", ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("all-rights-reserved", "apache2-notice", "apache2-compliance", "apache2-copy")),
    ("MIT", ("all-rights-reserved", "mit-grant", "mit-condition")),
    ("ISC", ("all-rights-reserved", "isc-grant")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-grant", "version2-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-grant", "version3-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-grant", "version2.1-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-grant", "version3-later")),
    ("LGPL-2.1-or-later", ("lgpl-grant", "version2.1-later")),
    ("LGPL-3.0-or-later", ("lgpl-grant", "version3-later")),
    ("GPL-2.0-or-later", ("gpl-grant", "version2-later")),
    ("GPL-3.0-or-later", ("gpl-grant", "version3-later")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("ISC", ("isc-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("Unlicense", ("unlicense-notice",)),
    ("CC0-1.0", ("cc0-grant",)),
    ("EPL-2.0", ("epl2-notice",)),
    *((name, (f"spdx-{name}",)) for name in SPDX),
    *((name, (f"spdx-{old}",)) for old, name in OLD_SPDX.items()),
    ("LicenseRef-Proprietary", ("all-rights-reserved",)),
)
#: What is rewritten before sentences are looked up, in this order: pattern and replacement.
#: A holder's name in a known sentence is the usual one; in an SPDX tag + is or-later, each name of an expression has a tag of
#: its own, and a tag is a line of its own, without the colon that would end a sentence.
REWRITES = (
    (r"neither(?:[^a-z0-9]+the)?[^a-z0-9]+names?[^a-z0-9]+of(?s:.{1,80}?)[^a-z0-9]nor[^a-z0-9]+the[^a-z0-9]+names[^a-z0-9]+of[^a-z0-9]+(?:its|their|other|any)[^a-z0-9]+contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"(spdx-license-identifier:[^\n]*[0-9])\+", "$1-or-later"),
    (r"(?<=spdx-license-identifier:[^\n]{0,200})[ \t)]+(?:or|and|with)[ \t(]+", "\nspdx-license-identifier: "),
    (r"spdx-license-identifier:[ \t(]*([a-z0-9.-]+)", "\nspdx license identifier $1\n"),
)
TAG = "spdx-license-identifier:"
#: A sentence ends at . ; : ! ? before white space, or at a blank or full line end.
SENTENCE_END = r"(?:[.;:!?]\s+|\n+)"
NOT_WORD = r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\."


def spelled(sentence: str) -> str:
    """The normal form of a sentence of the table above; normalised() is the same for columns."""
    return re.sub(" +", " ", re.sub(NOT_WORD, " ", sentence.lower())).strip()


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), NOT_WORD, " "), " +", " "))


def _starts(known: dict[str, str]) -> str:
    """A necessary condition of a known piece: its first two words, in any case, with any gap."""
    firsts = sorted({" ".join(piece.split()[:2]) for piece in known})
    return "(?iu)(?:" + "|".join(r"[^a-z0-9]+".join(x.replace(".", r"\.") for x in f.split()) for f in firsts) + ")"


def known_pieces(sentences: dict[str, str]) -> dict[str, str]:
    """Normal forms and identifiers; a sentence that is split itself has several, with one identifier."""
    known: dict[str, str] = {}
    for sentence, name in sentences.items():
        for piece in re.split(SENTENCE_END, sentence):
            if spelled(piece):
                known.setdefault(spelled(piece), name)
    return known


#: Between two words of a sentence: no terminator before white space, but at the start of a line, and no blank line.
GAP = r"(?![^a-z0-9\n]*[.;:!?]\s|[^a-z0-9]*\n[^a-z0-9.\n]*\n)[^a-z0-9]++"


def _wrapped(known: dict[str, str]) -> str:
    """Known pieces in a lower-case text, as group 1, longer ones first: from a line's or sentence's start to an end of one."""
    pieces = "|".join(GAP.join(re.escape(word) for word in piece.split()) for piece in sorted(known, key=lambda x: (-len(x), x)))
    end = r"[.;:!?]\s|\n"
    return rf"(?:\A|(?<=[a-z0-9])(?=[^a-z0-9]*?(?:{end})))[^a-z0-9]*+({pieces})(?=[^a-z0-9]*?(?:\z|{end}))"


def _rewritten(text: Column, rewrites: tuple) -> Column:
    for pattern, instead in rewrites:
        text = F.regexp_replace(text, pattern, instead)
    return text


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, sentence_ids (in text order, comma-joined), licenses (sorted, comma-joined), n_licenses."""
    known = known_pieces(sentences)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    holder, tags = REWRITES[:1], REWRITES[1:]
    text = F.when(F.contains(text, F.lit("neither")), _rewritten(text, holder)).otherwise(text)
    text = F.when(F.contains(text, F.lit(TAG)), _rewritten(text, tags)).otherwise(text)
    names = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(_wrapped(known)), F.lit(1)), lambda s: F.try_element_at(table, normalised(s))))
    # A text without the first words of any known sentence is not searched.
    found = docs.select("doc_id", F.when(text.rlike(_starts(known)), names).otherwise(F.array().cast("array<string>")).alias("names"))
    # A sentence of several pieces gives its identifier once.
    once = F.filter(F.transform("names", lambda x, i: F.when((i > 0) & (F.get("names", i - 1) == x), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    rows = found.select("doc_id", once.alias("ids"))
    state = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    rows = rows.withColumn("_left", state).withColumn("_got", F.array().cast("array<string>"))
    for name, ids in rules:
        needle = F.lit("|" + "||".join(ids) + "|")
        rows = rows.withColumn("_got", F.when(F.contains("_left", needle), F.array_append("_got", F.lit(name))).otherwise(F.col("_got"))).withColumn("_left", F.replace("_left", needle, F.lit("||")))
    licenses = F.array_sort(F.array_distinct("_got"))
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licenses, ",").alias("licenses"), F.size(licenses).cast("long").alias("n_licenses"))

