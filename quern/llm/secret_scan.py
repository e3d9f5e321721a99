"""Secret scan by assignment-aware lexing (operator 2).

A text is lexed as source and configuration files are written: strings (one line, triple or backtick, with prefixes and
escapes), names, assignment signs (``=``, ``:``, ``:=``, ``=>``), call arguments (``set("name", "literal")``), XML elements
and YAML lists and blocks. Each assignment gives a name and the terms of its right side: literals, joined where the source
joins them (``"a" + "b"``, strings side by side, parentheses over lines), lists item by item, and other names. What a
string holds is lexed too. Names and literals may have any length.

Constants are propagated in the order of the text: a name on a right side stands for its last assignment before that place,
or where there is none (configuration that refers forward) for its first one after it. A literal is scored by the most
sensitive name that reaches it and by its own length, alphabet and entropy; those of ``threshold`` or more are spans of
kind ``literal``. Three fixed patterns give the base spans of the kinds ``assign``, ``access`` and ``hex``; a scored literal
that lies inside a base span adds nothing.

Defined results: a null text is an empty one, without spans. Rows are independent, so ties, repeated rows and null ids
need no rule; extra columns are ignored; an empty table gives an empty result. Positions count code points, ends are
exclusive. Work is in proportion to a text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import bounded_batches, docs_of

KINDS = ("assign", "access", "hex", "literal")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
def _string(kind: str) -> str:
    """A closed string with a prefix or none; its groups kind1 to kind5 are what it holds. A quote right after a word is an apostrophe."""
    three = [rf"{q * 3}(?P<{kind}{i}>(?:[^{q}\\]|\\.|{q}(?!{q * 2}))*+){q * 3}" for i, q in ((1, '"'), (2, "'"))]
    one = [rf"{q}(?P<{kind}{i}>[^{q}\\\n]*+(?:\\[^\n][^{q}\\\n]*+)*+){q}" for i, q in ((3, '"'), (4, "'"))]
    return rf"(?<!\w)[rRbBuUfF]{{0,2}}(?:{'|'.join(three + one)}|`(?P<{kind}5>[^`\n]*+)`)"


SIGN = r"[ \t]*+(?P<sign>:=|=>|[:=](?![=:]))[ \t]*+"
#: What can begin an assignment: a string or name with a sign, also as a subscript (or, in a call, a string with a comma), a
#: preprocessor's definition, or an XML element or its attributes key and value.
HEAD = re.compile(
    rf"""\\.|\#[ \t]*+define[ \t]++(?P<def>[A-Za-z_]\w*+)[ \t]++(?=["\d\w])|\b(?:key|name)[ \t]*+=[ \t]*+["'](?P<attr>[A-Za-z_][\w.-]*+)["'][ \t]++(?:value|content)[ \t]*+(?==)|{_string("s")}(?:(?:[ \t]*+\])?{SIGN}|[ \t]*+(?P<comma>,)[ \t]*+(?=[rRbBuUfF]?["']))?|<(?P<tag>[A-Za-z_][\w.-]*+)>(?P<body>[^<>\s]++)</(?P=tag)>|(?<![\w.-])(?P<name>[A-Za-z_][\w.-]*+)["']?{SIGN.replace("sign", "sign2")}""", re.ASCII | re.DOTALL
)
TERM = re.compile(rf"""{_string("t")}|(?P<bare>[^\s"'`#,;(){{}}\[\]<>|+]++(?:\+[^\s"'`#,;(){{}}\[\]<>|+]+)*+\+?)""", re.ASCII | re.DOTALL)
NAME = re.compile(r"[A-Za-z_][\w.-]*+", re.ASCII)
#: After a name on a right side: its arguments, or what ``new`` makes.
CALL = re.compile(r"[ \t]*+(\()|(?<=\bnew)[ \t]++(?=[A-Za-z_])")
BLANK, BLANKS = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
#: After a YAML key without a value: its list items or block, by indentation.
BLOCK = re.compile(r"(?:[|>][+-]?\d?)?[ \t]*+\n")
LINE = re.compile(r"([ \t]*+)(- )?([^\n]*+)\n?")
#: Sensitive words in a name and their weights.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "key": 0.4}
#: Every sensitive name holds one of these; a text without any has no sensitive name.
SENSITIVE_HINT = re.compile("pass|pwd|secret|token|key|cred|auth|bearer", re.ASCII | re.IGNORECASE)
#: Whole literals that never are secrets.
HARMLESS = {"true", "false", "null", "none", "changeme", "example", "placeholder", "password", "secret", "token", "string", "undefined"}
THRESHOLD = 0.6


def name_weight(name: str) -> float:
    parts = [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(x, 0.0) for x in parts + joined), default=0.0)


def literal_weight(value: str) -> float:
    """0 to 1: long, mixed and evenly spread characters weigh more; words and numbers little."""
    n = len(value)
    if n < 8 or value.lower() in HARMLESS or " " in value:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(map(bool, (re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))))
    return min(1.0, entropy / 3.5) * (0.4, 0.5, 0.85, 1.0, 1.0)[kinds] * min(1.0, n / 12)


def _held(m: re.Match, kind: str) -> tuple[int, int] | None:
    """The span of what a string holds, if the match is one."""
    return next((m.span(f"{kind}{i}") for i in range(1, 6) if m[f"{kind}{i}"] is not None), None)


@dataclass
class Assignment:
    """A name, the literal pieces that its right side joins, and the names that occur there."""

    name: str
    at: int
    literals: list[tuple[int, int]]
    names: list[tuple[str, int, int]]


def _right_side(text: str, pos: int, end: int, name: str, at: int, sign: str) -> tuple[list[Assignment], int, list[tuple[int, int]]]:
    """The assignments of a right side that begins at pos (a list gives one for each item), where it ends, and its strings."""
    out, strings, depth, listed, resume = [Assignment(name, at, [], [])], [], 0, False, None
    if sign == ":" and (m := BLOCK.match(text, pos, end)) and text[pos : pos + 1] in "|>\n \t":
        return _indented(text, m.end(), end, name, at, text.rfind("\n", 0, at) + 1, m[0].strip() != "")
    while True:
        pos = (BLANKS if depth else BLANK).match(text, pos, end).end()
        c = text[pos : pos + 1]
        if c in ("(", "[") and c and not out[-1].literals and not out[-1].names:
            depth, listed, pos = depth + 1, listed or c == "[", pos + 1
            continue
        m = TERM.match(text, pos, end)
        if not m:
            break
        if held := _held(m, "t"):
            out[-1].literals.append(held)
            strings.append(held)
        elif NAME.fullmatch(m["bare"]) and (call := CALL.match(text, m.end(), end)) and not out[-1].literals and not out[-1].names:
            # new String("a"), getenv("X", "a"): each argument is an item, the function's own name isn't a value.
            if call[1]:
                depth, listed = depth + 1, True
            pos = call.end()
            continue
        elif NAME.fullmatch(m["bare"]):
            out[-1].names.append((m["bare"], *m.span("bare")))
            resume = m.start()  # it may be assigned itself: a = b = "c"
        else:
            out[-1].literals.append(m.span("bare"))
        pos = m.end()
        after = (BLANKS if depth else BLANK).match(text, pos, end).end()
        if text[after : after + 1] == "+":
            pos = BLANKS.match(text, after + 1, end).end()
        elif listed and text[after : after + 1] == ",":
            out.append(Assignment(name, at, [], []))
            pos = after + 1
        elif held and (n := TERM.match(text, after, end)) and _held(n, "t"):
            pos = after
        else:
            break
    return out, pos if resume is None else resume, strings


def _indented(text: str, pos: int, end: int, name: str, at: int, start: int, block: bool) -> tuple[list[Assignment], int, list[tuple[int, int]]]:
    """A YAML key's list items, or its block as one literal.

    What belongs to a key is indented more than the key itself stands; items of a list may stand right below it. So a line
    belongs to no more keys than it is indented by.
    """
    own = at - start - (text[at - 1 : at] in ('"', "'"))
    out, first, last = [], None, pos
    while pos < end and (m := LINE.match(text, pos, end)):
        deeper = len(m[1]) > own or (m[2] and len(m[1]) == own and not block)
        if not m[3].strip() and not m[2]:
            if not block or m.end() == pos:
                break
        elif not deeper or not (block or m[2]):
            break
        elif block:
            first, last = m.end(1) if first is None else first, m.end(3)
        else:
            value = TERM.match(text, m.start(3), m.end(3))
            if value and not text[value.end() : m.end(3)].strip():
                out.append(Assignment(name, at, [_held(value, "t") or value.span("bare")], []))
        if m.end() == pos:
            break
        pos = m.end()
    if first is not None:
        return [Assignment(name, at, [(first, last)], [])], last, []
    # Lines of a list are lexed on their own too.
    return out, last if block else at + len(name), []


def assignments(text: str) -> tuple[list[Assignment], int]:
    """All assignments: first those of the text in order, as many as the number says, then those that strings hold."""
    out: list[Assignment] = []
    parts = [(0, len(text))]
    outer = 0
    for k, (pos, end) in enumerate(parts):
        while pos < end and (m := HEAD.search(text, pos, end)):
            pos = m.end()
            held = _held(m, "s")
            if m["attr"] or m["def"]:
                kind = "attr" if m["attr"] else "def"
                pos += len(m["attr"] and "=" or "")
                found, after, strings = _right_side(text, pos, end, m[kind], m.start(kind), "=")
                out += [x for x in found if x.literals or x.names]
                pos = max(pos, after)
                parts += strings
            elif m["tag"]:
                out.append(Assignment(m["tag"], m.start("tag"), [m.span("body")], []))
            elif m["name"] or (held and (m["sign"] or m["comma"]) and NAME.fullmatch(text, *held)):
                name, at = (m["name"], m.start("name")) if m["name"] else (text[held[0] : held[1]], held[0])
                found, after, strings = _right_side(text, pos, end, name, at, m["sign2"] or m["sign"] or ",")
                out += [x for x in found if x.literals or x.names]
                pos = max(pos, after) if after > pos else pos
                parts += [x for x in strings if "=" in text[x[0] : x[1]] or ":" in text[x[0] : x[1]]]
                held = None
            if held and ("=" in text[held[0] : held[1]] or ":" in text[held[0] : held[1]]):
                parts.append(held)
        if k == 0:
            outer = len(out)
    return out, outer


def scored_literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, score) of each literal that reaches a sensitive name directly or through other names."""
    found, outer = assignments(text)
    # Where each name is assigned: in the text itself, or where it isn't, in what strings hold.
    where: dict[str, list[int]] = {}
    for some in (range(outer), range(outer, len(found))):
        known = set(where)
        for i in some:
            if found[i].name not in known:
                where.setdefault(found[i].name, []).append(i)
    weight = [name_weight(x.name) for x in found]
    reached: dict[int, float] = {}
    own: dict[int, list[tuple[int, int]]] = {}
    for level in sorted({w for w in weight if w}, reverse=True):
        todo = [i for i, w in enumerate(weight) if w == level and i not in reached]
        queued = set(todo)
        for i in todo:  # grows as names lead on; each assignment is visited once, by its most sensitive name
            if i in reached:
                continue
            reached[i] = level
            own[i] = list(found[i].literals)
            for name, start, stop in found[i].names:
                places = where.get(name)
                if not places:
                    # Alone, it may be a literal without quotes; joined to something else, it is some variable.
                    if len(found[i].literals) + len(found[i].names) == 1:
                        own[i].append((start, stop))
                    continue
                k = bisect.bisect_left(places, i)
                earlier = places[k - 1] if k else None
                if earlier is None:
                    later = [p for p in places[k : k + 2] if p != i]
                    earlier = later[0] if later else None
                if earlier is not None:
                    if earlier in queued:
                        continue  # its group came along with it
                    group = found[earlier].at
                    while earlier > 0 and found[earlier - 1].at == group and found[earlier - 1].name == name:
                        earlier -= 1
                    while earlier < len(found) and found[earlier].at == group and found[earlier].name == name:
                        if earlier not in queued:
                            queued.add(earlier)
                            todo.append(earlier)
                        earlier += 1
    best: dict[tuple[int, int], float] = {}
    for i, level in reached.items():
        pieces = sorted(own[i])
        if (score := level * literal_weight("".join("".join(text[a:b].split("\n")) if "\n" not in text[a:b] else "".join(text[a:b].split()) for a, b in pieces))) >= threshold:
            for at in pieces:
                if at[0] < at[1]:
                    best[at] = max(best.get(at, 0.0), score)
    return [(a, b, s) for (a, b), s in sorted(best.items())]


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind as KINDS lists them."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if SENSITIVE_HINT.search(text):
        out += [("literal", a, b) for a, b, _ in scored_literals(text, threshold) if not any(s <= a and b <= e for _, s, e in out)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            found = spans_of(text.as_py() or "")
            n = Counter(x[0] for x in found)
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in found if k != "literal")
            row = (n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in found), n["literal"])
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, types)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document with the number of spans of each kind, their digest and all spans; see the module."""
    bounded_batches(docs.sparkSession)
    return docs_of(docs, "doc_id", "text").mapInArrow(_scan, SCHEMA)
