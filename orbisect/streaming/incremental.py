"""Restartable and streaming runs: what is left to do, upserts by micro-batch, windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .buckets import BucketTable, newest

__all__ = ["newest", "remaining", "has_result", "run_remaining", "run_remaining_pairs", "structure_stream", "upsert_stream", "windowed_counts"]


def remaining(jobs: DataFrame, done: DataFrame, running: DataFrame | None = None, key: str = "struct_id") -> DataFrame:
    """Jobs that are neither done nor running."""
    left = jobs.join(done.select(key).distinct(), key, "left_anti")
    return left if running is None else left.join(running.select(key).distinct(), key, "left_anti")


def has_result(column: str) -> Column:
    """Whether a result counts as there: null, zero, false and empty ones don't."""
    text = F.col(column).cast("string")
    return F.coalesce(~text.isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False))


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_remaining(jobs: DataFrame, output: str, calculate: Callable[[DataFrame], DataFrame], key: str = "struct_id", result: str | None = None) -> DataFrame:
    """Calculate what the Parquet folder `output` lacks, append it there, and return the whole. A run that broke off left
    whole files or none, so the next one goes on from there. Jobs whose calculation gave no row are listed as done beside
    the output and not calculated again; with `result`, those without one are."""
    spark = jobs.sparkSession
    todo = jobs
    if there(spark, output):
        done = spark.read.parquet(output)
        todo = remaining(todo, done.where(has_result(result)) if result else done, key=key)
    if not result and there(spark, f"{output}-done"):
        todo = remaining(todo, spark.read.parquet(f"{output}-done"), key=key)
    calculate(todo).write.mode("append").parquet(output)
    if not result:
        done_now(jobs, output, key)
    return spark.read.parquet(output)


def done_now(jobs: DataFrame, output: str, key: str = "struct_id") -> None:
    """Add to the list beside the output the jobs that it lacks."""
    spark, path = jobs.sparkSession, f"{output}-done"
    ids = jobs.select(key).distinct()
    (remaining(ids, spark.read.parquet(path), key=key) if there(spark, path) else ids).write.mode("append").parquet(path)


def run_remaining_pairs(jobs: DataFrame, output: str, calculate: Callable[[DataFrame], DataFrame], key: str = "struct_id") -> DataFrame:
    """As run_remaining() for pairs (id1, id2) of jobs: of the jobs with a column `is_new`, calculate gives the pairs of which
    one is new. New is what the list of done jobs lacks; pairs that a run which broke off has left count once."""
    spark = jobs.sparkSession
    if there(spark, f"{output}-done"):
        old = spark.read.parquet(f"{output}-done").select(key).distinct().withColumn("__old", F.lit(True))
        marked = jobs.join(old, key, "left").withColumn("is_new", F.col("__old").isNull()).drop("__old")
    else:
        marked = jobs.withColumn("is_new", F.lit(True))
    found = calculate(marked)
    if there(spark, output):
        found = found.join(spark.read.parquet(output).select("id1", "id2").distinct(), ["id1", "id2"], "left_anti").select(*found.columns)
    found.write.mode("append").parquet(output)
    done_now(jobs, output, key)
    return spark.read.parquet(output)


def structure_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("multiLine", "true").option("maxFilesPerTrigger", files_per_batch).json(folder)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "struct_id", order: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep a table (buckets.BucketTable in the folder `table`) of the newest row of each key, by the column `order`, also
    against rows of earlier batches; without it the later batch wins, and within one batch any row of a key, but always the
    same. A micro-batch rewrites the buckets of its keys; one that is run again after a failure is merged once, as the table
    knows the stream's last batch. Another stream, or one with a fresh checkpoint, goes on with the table that is there."""
    kept = BucketTable(table, key, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        kept.upsert(batch, order, stream_id, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, by, n, total over event-time windows; as a stream it keeps state as far back as the watermark alone."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", F.col("total").cast("double").alias("total"))
