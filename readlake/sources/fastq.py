"""The ``fastq`` data source: byte ranges of plain files are read in parallel, gzip files one a task.

A record belongs to the range that its first byte is in. A range that begins within a file looks for the first place where four lines
are a valid record; that is unambiguous, as neither ``@`` nor ``+`` is a base.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import is_gzip, lines, local_paths

SCHEMA = "file_idx int, block_id bigint, rec bigint, id string, bases string, comment string, qual string"
BASES = re.compile(rb"[ACGTNacgtn]+\Z")


class Range(InputPartition):
    def __init__(self, file_idx: int, path: str, number: int, start: int, end: int):
        self.file_idx, self.path, self.number, self.start, self.end = file_idx, path, number, start, end


def valid(four: list[bytes]) -> bool:
    return four[0][:1] == b"@" and bool(BASES.match(four[1])) and four[2][:1] == b"+" and len(four[3]) == len(four[1])


def plain(four: list[bytes]) -> list[bytes]:
    """A record without its carriage returns, but for one after the id if all of its lines have one."""
    if not any(x.endswith(b"\r") for x in four):
        return four
    out = [x.removesuffix(b"\r") for x in four]
    return [out[0] + b"\r", *out[1:]] if all(x.endswith(b"\r") for x in four) else four


def records(r: Range, mode: str, keep_cr: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, four lines) of the records that begin in the range.

    Modes: FAILFAST raises at an invalid record; DROPMALFORMED goes on at the next valid one; PERMISSIVE gives the record as it is.
    """
    rows = lines(r.path, max(0, r.start - 1), keep_cr)
    if r.start:
        next(rows, None)  # the rest of a line that began before, or the end of the one before
    held: deque[tuple[int, bytes]] = deque()
    seeking = r.start > 0
    for at, line in rows:
        held.append((at, line))
        if len(held) < 4:
            if held[0][0] >= r.end:
                return
            continue
        if held[0][0] >= r.end:
            return
        four = plain([x for _, x in held]) if keep_cr else [x for _, x in held]
        if valid(four):
            yield held[0][0], four
            held.clear()
            seeking = False
        elif seeking or mode == "DROPMALFORMED":
            held.popleft()
        elif mode == "FAILFAST":
            raise ValueError(f"{r.path}: no valid record at byte {held[0][0]}")
        else:
            yield held[0][0], four
            held.clear()
    if any(x for _, x in held) and not seeking:
        if mode == "FAILFAST":
            raise ValueError(f"{r.path}: {len(held)} lines left over")
        if mode == "PERMISSIVE":
            yield held[0][0], [x for _, x in held] + [b""] * (4 - len(held))


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        self.split = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))
        self.keep_cr = options.get("keepcr", options.get("keepCR", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        out = []
        for i, p in enumerate(local_paths(self.path)):
            size = os.path.getsize(p)
            step = max(1, size) if is_gzip(p) else self.split
            out += [Range(i, p, k, a, (1 << 62) if is_gzip(p) else min(a + step, size)) for k, a in enumerate(range(0, max(1, size), step))]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        # A record's number: its place in the file, which orders records across ranges.
        for at, four in records(partition, self.mode, self.keep_cr):
            yield (partition.file_idx, partition.number, at, *(x.decode("latin-1") for x in four))


class FastqStream(DataSourceStreamReader):
    """Files of a folder as they come; a micro-batch has the files that are new in it."""

    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(local_paths(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = local_paths(self.path)
        return [Range(i, files[i], 0, 0, 1 << 62) for i in range(start["files"], end["files"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, four in records(partition, self.mode):
            yield (partition.file_idx, partition.number, at, *(x.decode("latin-1") for x in four))


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FastqStream(self.options)
