"""A data source "fastx" for user code: spark.read.format("fastx").load(path), batch and streaming readers of one kind.

sequences.read_fasta cuts files into records in the JVM and is the way for large files; this one reads file by file, and
shows how a source of sequences is plugged in: anything that yields (name, seq) can be registered the same way.
"""

from __future__ import annotations

import glob
import gzip
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def records(path: str) -> Iterator[tuple[str, str]]:
    """(header, sequence) of a FASTA or FASTQ file, gzip allowed; a, c, g, t in upper case."""
    upper = str.maketrans("acgt", "ACGT")
    with (gzip.open(path, "rt") if path.endswith(".gz") else open(path)) as f:
        head, parts = None, []
        for line in f:
            line = line.rstrip("\r\n")
            if line.startswith("@") and head is None:
                yield line[1:], next(f, "").rstrip("\r\n").translate(upper)
                next(f, None)
                next(f, None)
            elif line.startswith(">"):
                if head is not None:
                    yield head, "".join(parts).translate(upper)
                head, parts = line[1:], []
            else:
                parts.append(line.strip())
        if head is not None:
            yield head, "".join(parts).translate(upper)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, (head, seq) in enumerate(records(partition.value)):
            yield partition.value, n, head, seq


class FastxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "file string, record long, header string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(sorted(glob.glob(self.options["path"].removeprefix("file://"))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxDataSource)
