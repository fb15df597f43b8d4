"""Operator 2: mix sources to target weights.

A source's documents lie in a row, in pseudorandom order, and are cut into blocks of equal length in words. Slots of
output shards are drawn by categorical draws, so a shard's counts by source are multinomial; a source's j-th slot takes
block p(j) of its epoch's permutation p of the block indexes. Blocks and slots then meet by index. What the draws of
all shards miss or exceed a source's target by is put right in the last shard, so a source's words come out at its target.

Nothing here is dealt by source alone: a source's rows are cut into PARTS parts, its blocks and slots are many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, held, identity, workspace, written

PARTS = 4096
BUCKETS = 4096
ROUNDS = 20


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order of code points, null last; share: of all words; cap: copies of a source
    at most; block_words: words a block; shard_slots: blocks an output shard."""

    weights: tuple[float, ...] = (1, 2, 3)
    share: float = 1.0
    cap: int = 3
    block_words: int = 2048
    shard_slots: int = 1024
    seed: int = 42


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """A row for each document without its text: row (told apart when written), identity, doc_id, source, size, part."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *identity(), "doc_id", "source", n_words(F.col("text")).alias("size"))
    return rows.withColumn("part", F.pmod(F.xxhash64("__d", "__t"), F.lit(PARTS)).cast("int"))


def targets(parts: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source: idx, source, source_size, target.

    Targets are level * weight, or cap * size where that is less; the level is found at once from the order in which
    sources reach their caps. Windows without a partition here hold a row for each source.
    """
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    ranked = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(weights, F.col("idx") % len(mix.weights))).withColumn("most", F.lit(float(mix.cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "idx")
    total = F.lit(mix.share) * F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - before) / rest).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    found = levels.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return found.select("idx", "source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, key: list[Column], seed: int, inverse: bool = False) -> Column:
    """The image of index x under a pseudorandom permutation of 0..n-1: the swap-or-not shuffle. Each round swaps x and
    k - x (mod n) or not, by a bit that both share; as rounds undo themselves, the inverse runs them backwards."""

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit(seed), *key, i), n) - at
        other = F.pmod(other, n)
        bit = F.xxhash64(F.lit(~seed), *key, i, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(at)

    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*(F.lit(i) for i in rounds)), x, swap)


def slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """shard, idx, epoch, block, take: the blocks that each output shard takes, and how many of a block's words."""
    spark: SparkSession = sources.sparkSession
    b = F.lit(mix.block_words).cast("long")
    up = lambda x: F.ceil(x / mix.block_words).cast("long")
    s = sources.where("source_size > 0").withColumn("blocks", up(F.col("source_size"))).withColumn("want", F.round("target").cast("long"))
    s = s.withColumn("epochs", F.expr("want div source_size")).withColumn("more", F.expr("want % source_size"))
    s = s.withColumn("quota", F.col("epochs") * F.col("blocks") + F.when(F.col("more") > 0, F.least(F.col("blocks"), up(F.col("more")) + 1)).otherwise(0))
    s = s.withColumn("short", F.col("blocks") * b - F.col("source_size"))  # how much the last block lacks
    s = s.withColumn("last_at", permuted(F.col("blocks") - 1, F.col("blocks"), [F.col("idx"), F.col("epochs")], mix.seed, inverse=True))
    s = s.withColumn("hi", F.sum("quota").over(Window.orderBy("idx"))).withColumn("lo", F.col("hi") - F.col("quota"))
    total = s.agg(F.max("hi")).first()[0] or 0
    shards = -(-total // mix.shard_slots)
    # A draw falls in one of BUCKETS equal stretches of all quotas, and there in the source whose stretch holds it.
    width = max(1, -(-total // BUCKETS))
    draws = spark.range(total).select(F.expr(f"id div {mix.shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(mix.seed), "id"), F.lit(max(1, total))).alias("u"))
    held = s.where("quota > 0").select("idx", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bucket"))
    met = draws.withColumn("bucket", F.expr(f"u div {width}")).join(held, "bucket").where("u >= lo AND u < hi")
    counts = met.groupBy("shard", "idx").agg(F.count("*").alias("n"))
    own = counts.withColumn("start", F.sum("n").over(Window.partitionBy("idx").orderBy("shard")) - F.col("n"))
    drawn = counts.groupBy("idx").agg(F.sum("n").alias("start")).withColumn("shard", F.lit(shards).cast("long"))
    balance = s.select("idx").join(drawn, "idx", "left").select("idx", F.coalesce("shard", F.lit(shards)).alias("shard"), F.coalesce("start", F.lit(0)).alias("start"))
    runs = own.select("idx", "shard", "start", "n").unionByName(balance.withColumn("n", F.lit(None).cast("long"))).join(s.drop("source"), "idx")
    room = F.greatest(F.col("quota") - F.col("start"), F.lit(0))
    runs = runs.withColumn("n", F.least(F.coalesce("n", room), room)).where("n > 0")
    each = runs.select("*", F.explode(F.expr("sequence(start, start + n - 1)")).alias("j"))
    each = each.withColumn("epoch", F.expr("j div blocks")).withColumn("at", F.expr("j % blocks"))
    each = each.withColumn("block", permuted(F.col("at"), F.col("blocks"), [F.col("idx"), F.col("epoch")], mix.seed))
    size = b - F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(0)
    before = F.col("at") * b - F.when(F.col("last_at") < F.col("at"), F.col("short")).otherwise(0)
    take = F.when(F.col("epoch") < F.col("epochs"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("more") - before)))
    return each.select("shard", "idx", "epoch", "block", take.alias("take")).where("take > 0")


@dataclass
class Mixed:
    """What mixed() finds: rows (of sized()), sources (of targets()) and pieces: row, shard, epoch, first, n, which are the
    words of a document that a slot takes."""

    rows: DataFrame
    sources: DataFrame
    pieces: DataFrame
    folder: str


def mixed(docs: DataFrame, mix: Mix = Mix(), folder: str | None = None) -> Mixed:
    """Mix documents (doc_id, text, source).

    A document's size is its number of words; null texts have none and are never taken. Sources are weighed in order,
    null last. Rows that repeat each other, or only a doc_id, are documents each. More columns are ignored; an empty
    table gives empty results. Draws and permutations depend on the seed and the documents alone, so reruns agree.
    """
    folder = folder or workspace(docs.sparkSession, "mix")
    rows = written(sized(docs), folder, "rows")
    parts = written(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), folder, "parts")
    sources = written(targets(parts, mix), folder, "sources")
    taken = written(slots(sources, mix), folder, "slots")
    # Where each document begins in its source: its part's place in the source and its own in the part.
    upto = F.sum("part_size").over(Window.partitionBy("source").orderBy("part"))
    based = parts.withColumn("base", upto - F.col("part_size")).drop("part_size")
    based = based.join(sources.select("idx", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    based = written(based.withColumnsRenamed({"source": "s", "part": "p"}), folder, "bases")
    own = Window.partitionBy("source", "part").orderBy(F.xxhash64("__d", "__t", F.lit(mix.seed)), "__d", "__t", "row")
    placed = rows.where("size > 0").withColumn("in_part", F.sum("size").over(own) - F.col("size"))
    placed = placed.join(based, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    b = mix.block_words
    placed = placed.select("row", "idx", "size", (F.col("base") + F.col("in_part")).alias("start"))
    cut = placed.select("*", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
    cut = cut.withColumn("from", F.greatest(F.col("start") - F.col("block") * b, F.lit(0)))
    cut = cut.withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b)))
    met = cut.join(taken, ["idx", "block"]).withColumn("n", F.least("to", "take") - F.col("from")).where("n > 0")
    pieces = met.select("row", "shard", "epoch", (F.col("block") * b + F.col("from") - F.col("start")).alias("first"), "n")
    return Mixed(rows, sources, pieces, folder)


def taken_words(docs: DataFrame, mix: Mix = Mix(), folder: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    m = mixed(docs, mix, folder)
    counted = m.pieces.groupBy("row").agg(F.sum("n").alias("taken"))
    of = m.sources.select(F.col("source").alias("s"), "source_size", "target")
    out = m.rows.join(counted, "row", "left").join(of, F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), folder: str | None = None) -> DataFrame:
    """The mix as documents: for each document and epoch in which words of it are taken, a row with docs' columns whose text
    is what is taken, white space between words as it was; n_chars follows the text. Whole texts stay as they are.

    Takes belong to a doc_id, a text and a source: rows that repeat all three share them out in a fixed order, by the hash
    of their other columns. Null texts are never taken; docs' other columns pass through, whatever their names.
    """
    m = mixed(docs, mix, folder)
    spans = m.pieces.groupBy("row", "epoch").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("spans"))
    whole = m.rows.select("row", "__d", "__t", F.xxhash64(F.col("source").isNull(), "source").alias("__s"), "size").join(spans, "row")
    # Rows that repeat a doc_id, a text and a source are one key here; the k-th of them has the k-th list of takes.
    own = ["__d", "__t", "__s"]
    by_row = whole.groupBy(*own, "row").agg(F.array_sort(F.collect_list(F.struct("epoch", "spans", (F.col("n") == F.col("size")).alias("all")))).alias("takes"))
    ranked = Window.partitionBy(*own).orderBy("takes")
    takes = by_row.withColumn("__k", F.row_number().over(ranked)).drop("row")
    numbered = held(docs, F.xxhash64(F.col("source").isNull(), "source").alias("__s"))
    numbered = numbered.withColumn("__k", F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64("__doc"))))
    met = numbered.join(takes, [*own, "__k"]).select("__doc", F.explode("takes").alias("__take"))
    text = F.col("__doc").getField("text")
    pieces = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    some = F.transform(F.array(pieces), lambda w: F.array_join(F.flatten(F.transform("__take.spans", lambda s: F.slice(w, s["first"].cast("int") + 1, s["n"].cast("int")))), ""))[0]
    out = met.withColumn("__text", F.when(F.col("__take.all"), text).otherwise(some))
    named = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*(named.get(c, F.col("__doc").getField(c)).alias(c) for c in docs.columns))
