"""Operator 4: lines that many documents share.

Lines are hashed, and the hashes dealt by ranges of (hash, document) and sorted within by document and position, so a
frequent line spreads over many tasks and the first occurrence in each document streams by first. Documents a key are
counted from those first occurrences, merged before they move. What comes back for a document is a keep bitmap,
compressed to runs of dropped lines; the text itself moves once, to meet its bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC, ascii_lower, held, identity, stripped, workspace, written

KEY = ("__h1", "__h2")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """DOC, position and the 128-bit hash of each line's key; lines whose key is shorter than min_chars are left out."""
    rows = docs.select(*identity(), F.posexplode(lines_of(F.col("text"))).alias("__pos", "__line"))
    keyed = rows.select(*DOC, "__pos", ascii_lower(stripped(F.col("__line"))).alias("__key"))
    keyed = keyed.where((F.length("__key") >= min_chars) & (F.col("__key") != ""))
    return keyed.select(F.xxhash64("__key").alias(KEY[0]), F.xxhash64(F.lit(7), "__key").alias(KEY[1]), *DOC, "__pos")


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """A row for each key and document, with the key's positions there in order."""
    dealt = hashes.repartitionByRange(*KEY, *DOC).sortWithinPartitions(*KEY, *DOC, "__pos")
    return dealt.groupBy(*KEY, *DOC).agg(F.collect_list("__pos").alias("__at"))


def dropped_runs(docs: DataFrame, folder: str, min_docs: int, min_chars: int = 1) -> DataFrame:
    """DOC and `runs`, an array of (start, len): the lines that go, for documents that lose any."""
    # Hashes are written first: dealing by ranges reads its input twice, and hashing is the costly part.
    hashes = written(line_hashes(docs, min_chars), folder, "hashes")
    found = written(first_occurrences(hashes), folder, "occurrences")
    frequent = written(found.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(*KEY), folder, "frequent")
    gone = found.join(frequent, list(KEY), "left_semi").select(*DOC, F.explode("__at").alias("pos"))
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    runs = gone.withColumn("island", F.col("pos") - F.row_number().over(by_doc)).groupBy(*DOC, "island")
    spans = runs.agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
    return spans.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("runs"))


def without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, in order."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["len"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    return F.transform(F.array(lines), lambda x: F.flatten(F.transform(kept, lambda k: F.slice(x, k["a"] + 1, k["n"]))))[0]


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, folder: str | None = None) -> DataFrame:
    """docs with `text` after its frequent lines went, and the counts __n_lines and __n_dropped.

    A line's key is the line stripped of white space at both ends, A-Z lowered. Keys of min_chars or more code points
    (empty keys never) in min_docs or more documents lose all their lines. A null or empty text is one empty line.
    Rows that repeat a doc_id and a text are one document; rows that only share a doc_id, null too, are several. Other
    columns pass through, whatever their names, but for two that are called as the counts: these are replaced.
    """
    folder = folder or workspace(docs.sparkSession, "lines")
    runs = written(dropped_runs(docs, folder, min_docs, min_chars), folder, "bitmaps")
    rows = held(docs).join(runs.withColumnRenamed("runs", "__runs"), list(DOC), "left")
    text = F.col("__doc").getField("text")
    lines = lines_of(text)
    kept = F.when(F.col("__runs").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(without(lines, F.col("__runs")), "\n"))
    dropped = F.coalesce(F.aggregate("__runs", F.lit(0), lambda a, r: a + r["len"]), F.lit(0))
    counts = {"__n_lines": F.size(lines).cast("long"), "__n_dropped": dropped.cast("long")}
    own = [kept.alias(c) if c == "text" else F.col("__doc").getField(c).alias(c) for c in docs.columns if c not in counts]
    return rows.select(*own, *(v.alias(k) for k, v in counts.items()))
