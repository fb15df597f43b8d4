"""What the library needs of a session: a folder that all executors share, tables written there, and its own code."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this folder import the package from it, wherever the driver was started.

    On a cluster that doesn't mount the folder, ship the package with --py-files instead.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, in Spark's default store where it names none. Where it is unset, a local session,
    as in tests, gets a temporary one that goes at exit, and a cluster an error: its machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orbisect-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its store."""
    if "://" in path:
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder of its own for one call of an operator, below shared_dir()."""
    return f"{shared_dir(spark)}/orbisect/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and no task depends on an executor's disk."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str, least: int = 0) -> DataFrame:
    """df dealt by columns over as many tasks as a shuffle or the cores have, or `least`, however few bytes it is: where a small
    row is long work, Spark, which sizes tasks by bytes, would leave a whole table to one of them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least), *by)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table below the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
