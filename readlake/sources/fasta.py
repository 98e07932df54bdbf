"""The ``fasta`` data source: ``file_idx, contig, base0, seq``; sequences lie one after the other, headers name contigs. Blank lines are skipped."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import lines, local_paths

SEGMENT = 4096


class File(InputPartition):
    def __init__(self, file_idx: int, path: str):
        self.file_idx, self.path = file_idx, path


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[File]:
        return [File(i, p) for i, p in enumerate(local_paths(self.path))]

    def read(self, partition: File) -> Iterator[tuple]:
        contig, base0, held = "", 0, ""
        for _, line in lines(partition.path):
            if line[:1] == b">":
                if held:
                    yield partition.file_idx, contig, base0, held
                base0, held, contig = base0 + len(held), "", (line[1:].decode("latin-1").split() or [""])[0]
                continue
            held += line.decode("latin-1")
            while len(held) >= SEGMENT:
                yield partition.file_idx, contig, base0, held[:SEGMENT]
                base0, held = base0 + SEGMENT, held[SEGMENT:]
        if held:
            yield partition.file_idx, contig, base0, held


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file_idx int, contig string, base0 bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def contigs(segments: DataFrame) -> DataFrame:
    """``contig, base0, len``."""
    return segments.groupBy("contig").agg(F.min("base0").alias("base0"), F.sum(F.length("seq")).cast("long").alias("len"))
