"""A table of one row a key that upserts rewrite only where they touch it.

Keys are dealt to buckets by hash. A version of the table is a manifest that names a folder for each bucket; an upsert
writes new folders for the buckets of its keys and then a manifest, under a temporary name that is renamed, so readers see
all of it or nothing, and keep what they opened until it is removed. What an upsert reads and writes are those buckets.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.datasource import store


def newest(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of each key: that with the largest `order` (nulls least), ties by the rows' own contents."""
    by = F.struct(*([F.col(order)] if order else []), F.xxhash64(F.to_json(F.struct(*rows.columns))))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")


@dataclass(frozen=True)
class BucketTable:
    """path: a folder in a store that all executors share; key: never null in it; buckets: fixed once the table is made."""

    path: str
    key: str = "struct_id"
    buckets: int = 64

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(count)).cast("int")

    def manifest(self) -> dict | None:
        """The current version; None if there is no table yet."""
        fs, inner = store(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(f"{inner}/manifests", allow_not_found=True)) if f.extension == "json"]
        if not found:
            return None
        with fs.open_input_stream(max(found, key=lambda f: f.base_name).path) as f:
            return json.loads(f.read())

    def _publish(self, manifest: dict) -> None:
        """An error if another writer has published this version."""
        fs, inner = store(self.path)
        name = f"{inner}/manifests/{manifest['version']:012d}.json"
        fs.create_dir(f"{inner}/manifests", recursive=True)
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            raise RuntimeError(f"another writer has published version {manifest['version']}")
        temp = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as out:
            out.write(json.dumps(manifest).encode())
        fs.move(temp, name)

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """The rows of the current version, or of some of its buckets."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"{self.path} holds no table")
        folders = [f for b, f in now["folders"].items() if only is None or int(b) in only]
        schema = T.StructType.fromJson(now["schema"])
        return spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, order: str | None = None, source: str = "", batch: int = -1) -> dict:
        """Merge rows: of each key the newest by `order` stays, also against what is there; without it rows stand before what is
        there. Rows without a key are an error. A batch of a source that is merged already is not merged again. Returns the
        manifest."""
        return self._merge(rows, order, source, batch, gone=False)

    def delete(self, keys: DataFrame) -> dict:
        """Remove the rows of keys (a column called as the key)."""
        return self._merge(keys, None, "", -1, gone=True)

    def _merge(self, rows: DataFrame, order: str | None, source: str, batch: int, gone: bool) -> dict:
        spark, now = rows.sparkSession, self.manifest()
        if now and source and now["batches"].get(source, -1) >= batch:
            return now
        count = now["buckets"] if now else self.buckets
        name = f"{(now['version'] if now else 0) + 1:012d}-{uuid.uuid4().hex}"
        if not gone:
            rows = newest(rows, self.key, order)
        staged = f"{self.path}/staged/{name}"  # read twice, computed once
        rows.withColumn("__b", F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a row has no key"))).otherwise(self._bucket(count))).write.parquet(staged)
        fresh = spark.read.parquet(staged)
        touched = [r[0] for r in fresh.select("__b").distinct().collect()]  # at most as many as buckets
        schema = T.StructType.fromJson(now["schema"]) if now else rows.schema
        fresh = fresh.drop("__b")
        if gone:
            merged = self.read(spark, touched).join(fresh.select(self.key), self.key, "left_anti") if now else spark.createDataFrame([], schema)
        elif now:
            old = self.read(spark, touched)
            fresh = fresh.select(*(F.col(f.name).cast(f.dataType) for f in schema))
            merged = newest(old.unionByName(fresh), self.key, order) if order else old.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh)
        else:
            merged = fresh
        dealt = merged.select(*schema.names).withColumn("__b", self._bucket(count)).repartition("__b")
        dealt.write.partitionBy("__b").parquet(f"{self.path}/data/{name}")
        fs, inner = store(self.path)
        made = {f.base_name.partition("=")[2] for f in fs.get_file_info(pafs.FileSelector(f"{inner}/data/{name}")) if f.type == pafs.FileType.Directory}
        folders = {b: f for b, f in (now["folders"] if now else {}).items() if int(b) not in touched} | {b: f"{name}/__b={b}" for b in made}
        batches = dict(now["batches"] if now else {}) | ({source: batch} if source else {})
        new = {"version": (now["version"] if now else 0) + 1, "buckets": count, "schema": json.loads(schema.json()), "folders": folders, "batches": batches}
        self._publish(new)
        fs.delete_dir(f"{inner}/staged/{name}")
        return new

    def vacuum(self) -> int:
        """Remove the folders that the current version doesn't name, and older manifests; returns how many folders went."""
        now, gone = self.manifest(), 0
        if now is None:
            return 0
        fs, inner = store(self.path)
        kept = set(now["folders"].values())
        for write in fs.get_file_info(pafs.FileSelector(f"{inner}/data", allow_not_found=True)):
            own = [f for f in fs.get_file_info(pafs.FileSelector(write.path)) if f.type == pafs.FileType.Directory]
            for f in own:
                if f"{write.base_name}/{f.base_name}" not in kept:
                    fs.delete_dir(f.path)
                    gone += 1
            if all(f"{write.base_name}/{f.base_name}" not in kept for f in own):
                fs.delete_dir(write.path)
        for f in fs.get_file_info(pafs.FileSelector(f"{inner}/manifests")):
            if f.base_name != f"{now['version']:012d}.json":
                fs.delete_file(f.path)
        return gone
