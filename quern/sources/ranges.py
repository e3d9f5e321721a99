"""Token shards as a Python data source whose partitions are byte ranges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources.stores import store_of


#: A task takes several ranges, up to so many tokens, where there are more ranges than ``tasks``.
MOST_TASK_TOKENS = 1 << 24


@dataclass
class _Range:
    """Tokens [first, stop) of a shard of size tokens."""

    path: str
    size: int
    first: int
    stop: int


@dataclass
class _Ranges(InputPartition):
    ranges: list[_Range]


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = json.loads(options["files"])
        self.overlap, self.row, self.task = (int(options[k]) for k in ("overlap", "rowtokens", "tasktokens"))
        self.tasks = int(options.get("tasks", 1 << 62))
        self.named = options.get("store")
        if self.overlap < 0 or self.row < 1 or self.task < 1:
            raise ValueError("overlap can't be negative, rowTokens and taskTokens must be positive")

    def partitions(self) -> list[_Ranges]:
        step = -(-self.task // self.row) * self.row  # rows are the same, however the work is cut
        files, self.files = self.files, []  # each task gets this reader: without the list of all files
        room = max(step, min(MOST_TASK_TOKENS, sum(n // 2 for _, n in files) // self.tasks))
        out, left = [_Ranges([])], room
        for path, n in files:
            for a in range(0, n // 2, step):
                b = min(a + step, n // 2)
                if out[-1].ranges and b - a > left:
                    out.append(_Ranges([]))
                    left = room
                out[-1].ranges.append(_Range(path, n // 2, a, b))
                left -= b - a
        return out

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            yield from self._range(r)

    def _range(self, part: _Range) -> Iterator[pa.RecordBatch]:
        folder = part.path.rpartition("/")[0]
        with store_of(folder, self.named).open(part.path) as file:
            for first in range(part.first, part.stop, self.row):
                own = min(self.row, part.stop - first)
                wanted = min(own + self.overlap, part.size - first)
                file.seek(2 * first)
                raw = file.read(2 * wanted)
                if len(raw) < 2 * wanted:
                    raise OSError(f"{part.path} ends after {2 * first + len(raw)} bytes")
                tokens = pa.array(np.frombuffer(raw, "<u2").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array([0, wanted], pa.int32()), tokens)
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.size]), pa.array([first]), pa.array([own]), lists], ["path", "size", "first", "own", "tokens"])


class TokenRanges(DataSource):
    """Format "token_ranges": headerless files of little-endian 16-bit tokens, read in ranges.

    Options: files (a JSON list of paths and bytes), overlap, rowTokens, taskTokens, tasks (no more
    than taskTokens needs are made as long as there are so many), store (see stores.py).
    """

    @classmethod
    def name(cls) -> str:
        return "token_ranges"

    def schema(self) -> str:
        return "path string, size long, first long, own long, tokens array<int>"

    def reader(self, schema) -> _RangeReader:
        return _RangeReader(self.options)
