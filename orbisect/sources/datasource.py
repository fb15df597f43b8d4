"""`structures` as a data source: spark.read, df.write, spark.readStream with format("structures").

A write is a run: a folder run-<number> that appears at once. Tasks write below a hidden folder, a sub-folder for each
attempt; the commit drops attempts that didn't count, and renames the folder, so a reader sees all of a run or nothing,
and a failed job leaves nothing. Runs are numbered, so a stream's offset is the number of the last one that it read.

Reads take loose files of a folder and its runs, in splits of bounded size. Filters on the path, and on ids of runs,
whose files are named by them, decide which files are opened at all.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from ..operators.structures import STRUCTURE_SCHEMA
from . import parsers

#: Bytes of a split, and what a file counts beside its own.
SPLIT, OPEN = 16 << 20, 64 << 10
RUN = re.compile(r"run-(\d{12})")
TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs, inner.rstrip("/")


def listed(fs: pafs.FileSystem, folder: str, recursive: bool = False) -> list[pafs.FileInfo]:
    return [f for f in fs.get_file_info(pafs.FileSelector(folder, recursive=recursive, allow_not_found=True)) if not re.search(r"/[._][^/]*(/|$)", f.path[len(folder) :])]


def runs(fs: pafs.FileSystem, folder: str) -> list[tuple[int, str]]:
    """Numbers and folders of the runs, in order."""
    return sorted((int(m[1]), f.path) for f in listed(fs, folder) if f.type == pafs.FileType.Directory and (m := RUN.fullmatch(f.base_name)))


@dataclass
class Files(InputPartition):
    uri: str
    paths: tuple[str, ...]


def packed(uri: str, found: list[tuple[str, int]], most: int = SPLIT) -> list[Files]:
    """Files in order of their paths, in splits of about `most` bytes; a larger file is one of its own."""
    out: list[list[str]] = []
    size = most + 1
    for path, n in sorted(found):
        if size + n + OPEN > most:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n + OPEN
    return [Files(uri, tuple(p)) for p in out]


def parsed(split: Files, file_format: str) -> Iterator[tuple]:
    fs, _ = store(split.uri)
    for path in split.paths:
        with fs.open_input_stream(path) as f:
            content = f.read()
        for r in parsers.parse(content, path, file_format):
            yield r["struct_id"], r["elements"], r["geometry"], r["lattice"], r["properties"], path


class StructureSource(DataSource):
    """Options: path; format where extensions don't say it, and of what is written (json); recursive, for loose files in
    sub-folders; splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return f"{STRUCTURE_SCHEMA}, source_path string"

    def reader(self, schema) -> DataSourceReader:
        return StructureReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StructureStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StructureWriter(self.options, schema.fieldNames(), overwrite)


class StructureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Take tests of struct_id and source_path; give back the others."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("struct_id",), ("source_path",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def passes(self, column: str, value: str | None) -> bool:
        return all(value is not None and TESTS[kind](value, v) for c, kind, v in self.tests if c == column)

    def opened(self) -> list[tuple[str, int]]:
        """Paths and sizes of the files to open."""
        fs, inner = store(self.options["path"])
        if fs.get_file_info(inner).type == pafs.FileType.File:
            loose, own = [fs.get_file_info(inner)], []
        else:
            deep = self.options.get("recursive", "false").lower() == "true"
            folders = [path for _, path in runs(fs, inner)]
            loose = [f for f in listed(fs, inner, deep) if not any(f.path.startswith(f"{r}/") for r in folders)]
            own = [f for r in folders for f in listed(fs, r, True)]
        wanted = {quote(v, safe="") for c, kind, value in self.tests if c == "struct_id" and kind in (EqualTo, In) for v in (value if kind is In else (value,)) if v is not None}
        named = any(c == "struct_id" and kind in (EqualTo, In) for c, kind, _ in self.tests)
        own = [f for f in own if not named or f.base_name.rpartition(".")[0] in wanted]
        return [(f.path, f.size) for f in (*loose, *own) if f.type == pafs.FileType.File and self.passes("source_path", f.path)]

    def partitions(self) -> list[InputPartition]:
        return packed(self.options["path"], self.opened(), int(self.options.get("splitbytes", SPLIT)))

    def read(self, partition: Files) -> Iterator[tuple]:
        return (r for r in parsed(partition, self.options.get("format", "")) if self.passes("struct_id", r[0]))


class StructureStream(DataSourceStreamReader):
    """The runs of a folder, as they are committed."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"run": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, inner = store(self.options["path"])
        return {"run": max((n for n, _ in runs(fs, inner)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, inner = store(self.options["path"])
        found = [f for n, path in runs(fs, inner) if start["run"] < n <= end["run"] for f in listed(fs, path, True)]
        return packed(self.options["path"], [(f.path, f.size) for f in found if f.type == pafs.FileType.File], int(self.options.get("splitbytes", SPLIT)))

    def read(self, partition: Files) -> Iterator[tuple]:
        return parsed(partition, self.options.get("format", ""))


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    rows: int


class StructureWriter(DataSourceWriter):
    """A file for each row, named by its quoted id. Append adds a run, overwrite replaces all runs by one; loose files stay. A row
    without an id is an error, and so is a format that can't be written."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.format = parsers.checked_format(options.get("format") or "json")
        self.staging = f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Attempt:
        task = TaskContext.get()
        fs, inner = store(self.path)
        folder, rows = f"{task.partitionId():08d}-{task.taskAttemptId()}", 0
        ext, text = parsers.WRITERS[self.format]
        for row in iterator:
            r = dict(zip(self.columns, row, strict=True))
            if r["struct_id"] is None:
                raise ValueError("a structure without an id can't be written")
            if not rows:
                fs.create_dir(f"{inner}/{self.staging}/{folder}", recursive=True)
            r |= {"geometry": [list(p) for p in r["geometry"] or []], "lattice": [list(v) for v in r.get("lattice") or []], "elements": list(r["elements"] or []), "properties": dict(r.get("properties") or {})}
            with fs.open_output_stream(f"{inner}/{self.staging}/{folder}/{quote(r['struct_id'], safe='')}.{ext}") as out:
                out.write(text(r).encode())
            rows += 1
        return Attempt(folder, rows)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, inner = store(self.path)
        staging = f"{inner}/{self.staging}"
        fs.create_dir(staging, recursive=True)
        counted = {m.folder for m in messages if m}
        for f in fs.get_file_info(pafs.FileSelector(staging)):
            if f.base_name not in counted:
                fs.delete_dir(f.path)
        before = runs(fs, inner)
        fs.move(staging, f"{inner}/run-{max((n for n, _ in before), default=0) + 1:012d}")
        for _, path in before if self.overwrite else ():
            fs.delete_dir(path)

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, inner = store(self.path)
        if fs.get_file_info(f"{inner}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{self.staging}")


def register(spark: SparkSession) -> None:
    """Name the source in a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StructureSource)
