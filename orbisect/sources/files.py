"""Folders of structure files as frames, and frames as folders of files.

Files are listed and read by Spark's binaryFile source, so any store that Spark reads will do and a folder is read by
many tasks; parsing happens in Arrow batches where the bytes are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structures import STRUCTURE_SCHEMA, last_wins
from ..session import reachable
from . import parsers


def read(spark: SparkSession, path: str, file_format: str = "", recursive: bool = False, folder_names: Sequence[str] = (), path_ids: bool = False) -> DataFrame:
    """Structures of a file or folder: struct_id, elements, geometry, lattice, properties, source_path.

    Names that begin with a dot and unreadable files are left out. recursive: sub-folders too, those named folder_names
    alone where any are given. path_ids: ids are the path below `path`, joined by _ without its extension.
    """
    reachable(spark)
    if file_format:
        parsers.checked_format(file_format)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", "content").where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    if folder_names:
        files = files.where(F.element_at(F.split("path", "/"), -2).isin(*folder_names))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{**r, "source_path": p} for p, c in zip(frame["path"], frame["content"], strict=True) for r in parsers.parse(bytes(c), p, file_format)]
            if rows:
                yield pd.DataFrame(rows)

    out = files.mapInPandas(run, f"{STRUCTURE_SCHEMA}, source_path string")
    if path_ids:
        below = F.regexp_replace(F.col("source_path"), r"^.*?" + path.rstrip("/").rpartition("/")[2] + "/", "")
        out = out.withColumn("struct_id", F.regexp_replace(F.regexp_replace(below, r"\.[^./]*$", ""), "/", "_"))
    return out


def read_dictionary(spark: SparkSession, path: str, file_format: str = "") -> DataFrame:
    """A folder with one row an id: of several files with one id the last by path stands."""
    return last_wins(read(spark, path, file_format), ["source_path"])


def has_structures(spark: SparkSession, path: str) -> bool:
    return bool(read(spark, path).take(1))


def write(structures: DataFrame, path: str, file_format: str = "json", combined: bool = False, overwrite: bool = False) -> None:
    """A file for each structure, named by its id; combined: JSON lines of documents in Spark's own layout, which reads back
    with spark.read.json. Without overwrite a folder that holds files is an error."""
    parsers.checked_format(file_format)
    if combined:
        if file_format != "json":
            raise ValueError("only json combines structures in a file")
        structures.select(*(c for c in ("struct_id", "geometry", "elements", "lattice", "properties"))).write.mode("overwrite" if overwrite else "errorifexists").json(path)
        return
    uri = path if "://" in path else f"file://{path}"
    fs, inner = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        raise FileExistsError(f"{path} is a file")
    if info.type == pafs.FileType.Directory and not overwrite and fs.get_file_info(pafs.FileSelector(inner)):
        raise FileExistsError(f"{path} holds files; pass overwrite=True")
    fs.create_dir(inner, recursive=True)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = pafs.FileSystem.from_uri(uri)
        ext, text = parsers.WRITERS[file_format]
        for frame in frames:
            names = []
            for r in frame.to_dict("records"):
                r = {**r, "geometry": [list(map(float, p)) for p in r["geometry"]], "lattice": [list(map(float, v)) for v in r["lattice"]], "elements": list(r["elements"]), "properties": dict(r["properties"] or {})}
                name = f"{folder}/{r['struct_id']}.{ext}"
                temp = f"{name}.{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(temp) as out:
                    out.write(text(r).encode())
                store.move(temp, name)
                names.append(name)
            yield pd.DataFrame({"file": names})

    structures.select("struct_id", "elements", "geometry", "lattice", "properties").mapInPandas(run, "file string").count()


def write_formats(structures: DataFrame, path: str, formats: Sequence[str] = ("json", "geometry"), overwrite: bool = False) -> None:
    """A sub-folder for each format."""
    for f in formats:
        write(structures, f"{path}/{f}", f, overwrite=overwrite)
