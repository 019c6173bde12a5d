"""Files of genotype tables as a data source: ``spark.read.format("genotypes")``.

Each file has a header of its own, read once, by the driver; tasks read ranges of
bytes and decode only the columns of the individuals asked for. Paths are those
that pyarrow can open (local folders, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from haploweave.sources.text import paths_of
from haploweave.sources.vcf import FIXED

#: Bytes of a task, and calls of a batch.
SPLIT, BATCH = 64 << 20, 1 << 18
SCHEMA = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("calls", pa.list_(pa.string()))])


def _place(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:") and not path.startswith("file://") else path)


def _files(path: str) -> list[tuple[str, int]]:
    """Paths, as pyarrow's file system of ``path`` names them, and bytes of its files; empty ones are left out."""
    system, at = _place(path)
    info = system.get_file_info(at)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(files.FileSelector(at)) if f.is_file and f.base_name[0] not in "_."]
    return sorted((f.path, f.size) for f in found if f.size)


def _open(root: str, path: str, start: int = 0) -> io.BufferedIOBase:
    """The file's bytes from ``start``; a compressed one from its first."""
    raw = _place(root)[0].open_input_file(path)
    if path.endswith((".gz", ".bgz")):
        return io.BufferedReader(gzip.GzipFile(fileobj=raw))
    raw.seek(start)
    return io.BufferedReader(raw, 1 << 20)


def individuals(root: str, path: str) -> list[tuple[int, str]]:
    """(column, name) of the file's header; none before the first site is an error."""
    with _open(root, path) as lines:
        for line in lines:
            if line.startswith(b"#CHROM"):
                return [(k, name) for k, name in enumerate(line.decode().split()) if name not in FIXED]
            if not line.startswith(b"#") and line.strip():
                break
    raise ValueError(f"{path} has no header line")


@dataclass
class Range(InputPartition):
    root: str
    path: str
    start: int
    #: One past the last byte at which a line may begin; none: all.
    stop: int | None
    columns: list[int]


class _Reader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("no input path is given")
        self.roots = paths_of(options["path"])
        self.names = json.loads(options["samples"]) if options.get("samples") else None
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        names, out = None if self.names is None else set(self.names), []
        order: list[str] | None = None
        for root in self.roots:
            for path, size in _files(root):
                at = {name: k for k, name in individuals(root, path)}
                if order is None:  # of the first file, for all
                    order = [name for name in at if names is None or name in names]
                    if not order:
                        raise ValueError("no individual is selected")
                lost = [name for name in order if name not in at]
                if lost:
                    raise ValueError(f"{path} lacks {lost[:3]}")
                columns = [at[name] for name in order]
                if path.endswith((".gz", ".bgz")):
                    out.append(Range(root, path, 0, None, columns))
                else:
                    out += [Range(root, path, a, min(a + self.split, size), columns) for a in range(0, size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        chrom, pos, calls, last = [], [], [], max(partition.columns)
        for line in _lines(partition):
            if line.startswith(b"#"):
                continue
            f = line.split(None, last + 1)
            if not f:
                continue
            chrom.append(f[0])
            pos.append(int(f[1]) if len(f) > 1 and f[1].isdigit() else None)
            calls += [f[k] if k < len(f) else None for k in partition.columns]
            if len(calls) >= BATCH:
                yield _batch(chrom, pos, calls, len(partition.columns))
                chrom, pos, calls = [], [], []
        if chrom:
            yield _batch(chrom, pos, calls, len(partition.columns))


def _lines(r: Range) -> Iterator[bytes]:
    """Lines that begin within the range."""
    at = r.start
    with _open(r.root, r.path, max(at - 1, 0)) as lines:
        if at:  # up to the end of the line that holds the byte before
            at += len(lines.readline()) - 1
        for line in lines:
            if r.stop is not None and at >= r.stop:
                return
            at += len(line)
            yield line


def _batch(chrom: list, pos: list, calls: list, width: int) -> pa.RecordBatch:
    held = pa.ListArray.from_arrays(pa.array(range(0, len(calls) + 1, width), pa.int32()), pa.array(calls, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(chrom, pa.binary()).cast(pa.string()), pa.array(pos, pa.int64()), held], schema=SCHEMA)


class Genotypes(DataSource):
    """Options: path (files or folders, separated by commas), samples (a JSON list of names; none: all), split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "genotypes"

    def schema(self) -> str:
        return "chrom string, pos long, calls array<string>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, paths: str, ids: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """chrom, pos, calls of all data lines of the files: the calls of every individual, or of those in ``ids(sample)``, in the order of the first file's header.

    Files may hold individuals in different orders; one that lacks an individual, a
    file without a header and no selected individual are errors. A position that is
    no number is null, as is a call that a line lacks; blank lines and empty files are skipped.
    Compressed files (.gz, .bgz) are one task each.
    """
    spark.dataSource.register(Genotypes)
    rows = spark.read.format("genotypes").option("path", ",".join(paths_of(paths))).option("split", split)
    if ids is not None:
        first = next((individuals(root, path) for root in paths_of(paths) for path, _ in _files(root)), [])
        header = spark.createDataFrame([(name,) for _, name in first], "sample string")
        rows = rows.option("samples", json.dumps([r["sample"] for r in header.join(ids, "sample", "left_semi").collect()]))  # of one header at most
    return rows.load()
