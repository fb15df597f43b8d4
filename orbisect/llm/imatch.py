"""Operator 8: document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency, counted over all documents. It is cut by hash
into SUBSETS random parts, and thinned, by hash again, by a power of two that follows from how many terms a text has, so
that a part keeps a few of them. A part's distinct terms, sorted, are hashed; a fingerprint has these hashes at a text's
own thinning and the next. Two texts are as like as the share of parts whose hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, identity, workspace, written
from .quality import let

SUBSETS = 10
#: A text of n distinct terms is thinned until at most 2 * FEW * SUBSETS of them are expected.
FEW = 2
#: The band: terms in N ** (1 - HIGH) to N ** (1 - LOW) of N documents, or their idf from LOW to HIGH times ln N.
LOW, HIGH = 0.25, 0.95
TERM = r"[\p{L}\p{N}]+"
#: Documents a stretch of doc_ids, and stretches at most.
STRETCH, STRETCHES = 256, 8192


def term_hashes(text: Column) -> Column:
    found = F.regexp_extract_all(ascii_lower(text), F.lit(f"({TERM})"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda t: F.xxhash64(t))


def thinning(terms: Column) -> Column:
    """The power of two by which a text with these terms is thinned."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)) / (FEW * SUBSETS)))).cast("int")


def thinned(terms: Column, by: Column) -> Column:
    return F.filter(terms, lambda h: h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), by) - 1) == 0)


def sampled(text: Column) -> Column:
    """(by, terms): a text's thinning and the terms left of it."""
    return let(term_hashes(text), lambda t: F.struct(thinning(t).alias("by"), thinned(t, thinning(t)).alias("terms")))


def signatures(terms: Column, by: Column) -> Column:
    """The hash of each part's sorted terms at thinning `by`, then of each part's at by + 1; null where none is left."""
    part = lambda h: F.pmod(F.shiftrightunsigned(h, 32), F.lit(SUBSETS))

    def at(more: int) -> Column:
        kept = thinned(terms, by + more)
        own = lambda t, k: F.array_sort(F.filter(t, lambda h: part(h) == k))
        sign = lambda x: F.when(F.size(x) > 0, F.xxhash64(x))
        return let(kept, lambda t: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: let(own(t, k), sign)))

    return F.concat(at(0), at(1))


def as_string(by: Column, signs: Column, whole: Column) -> Column:
    """A fingerprint in print; a text without lexicon terms is known by the hash of its whole text alone."""
    parts = F.transform(signs, lambda s: F.coalesce(F.lower(F.hex(s)), F.lit("-")))
    some = F.exists(signs, lambda s: s.isNotNull())
    return F.when(some, F.concat_ws(":", by, F.array_join(parts, ":"))).otherwise(F.concat(F.lit("text:"), F.lower(F.hex(whole))))


def likeness(by_a: Column, a: Column, print_a: Column, by_b: Column, b: Column, print_b: Column) -> Column:
    """Share of the parts that agree, of those where either text has a term, at the thinnings that both have."""
    top = F.greatest(by_a, by_b)
    own = lambda s, by: F.when(by_a == by_b, s).otherwise(F.slice(s, (top - by) * SUBSETS + 1, SUBSETS))
    pairs = F.arrays_zip(own(a, by_a).alias("x"), own(b, by_b).alias("y"))
    agree = F.size(F.filter(pairs, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))))
    some = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    score = F.when((F.abs(by_a - by_b) <= 1) & (some > 0), agree / F.greatest(some, F.lit(1))).otherwise(F.lit(0.0))
    return F.when(print_a == print_b, F.lit(1.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def stretches(docs: DataFrame) -> tuple[int, Column]:
    """How many rows docs has, and a column that numbers stretches of ascending doc_ids of about STRETCH rows each.

    The stretches' bounds, at most STRETCHES - 1 numbers, are the one thing that comes to the driver.
    """
    n = docs.select("doc_id").count()
    k = max(1, min(STRETCHES, n // STRETCH))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 20 * STRETCHES)).first()[0] or []
    bounds = sorted(set(bounds)) if k > 1 else []
    if not bounds:
        return n, F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
    # Binary search: how many bounds are at or below the doc_id.
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= F.col("__d"), at + s).otherwise(at))
    return n, below


def with_next(docs: DataFrame) -> tuple[int, DataFrame]:
    """docs' doc_id and text with __d, __t and the next document's (__nd, __nt, __next) in ascending doc_id order; the first's
    for the last. Null doc_ids come first, ties go by the texts' hashes. Each text moves once, to its stretch."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *identity())
    n, stretch = stretches(docs)
    rows = rows.withColumn("__s", stretch)
    # A stretch's first document is also put at the end of the stretch before: as many rows as there are stretches.
    firsts = rows.groupBy("__s").agg(F.min(F.struct("__d", "__t")).alias("f"))
    back = F.coalesce(F.lag("__s").over(Window.orderBy("__s")), F.max("__s").over(Window.partitionBy()))
    copied = firsts.select(back.alias("__to"), F.col("f.__d").alias("__fd"), F.col("f.__t").alias("__ft"))
    ends = rows.join(F.broadcast(copied), (F.col("__d") == F.col("__fd")) & (F.col("__t") == F.col("__ft")))
    ends = ends.select("doc_id", "text", "__d", "__t", F.col("__to").alias("__s"), F.lit(1).alias("__end"))
    order = Window.partitionBy("__s").orderBy("__end", "__d", "__t")
    both = rows.withColumn("__end", F.lit(0)).unionByName(ends)
    follows = F.lead(F.struct("__d", "__t", "text")).over(order)
    found = both.withColumn("__f", follows).where("__end = 0")
    return n, found.select("doc_id", "text", "__d", "__t", F.col("__f.__d").alias("__nd"), F.col("__f.__t").alias("__nt"), F.col("__f.text").alias("__next"))


def lexicon(docs: DataFrame, n: int, low: float = LOW, high: float = HIGH) -> DataFrame:
    """h: the hashes of terms whose document frequency lies in the band, counted over all documents."""
    counts = docs.select(F.explode(term_hashes(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return counts.where(F.col("df").between(n ** (1 - high) - 1e-9, n ** (1 - low) + 1e-9)).select("h")


def fingerprinted(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next document.
    Null texts are empty; a text without lexicon terms, the empty one too, is like its equals only. Rows that repeat a
    doc_id are documents in the order of their texts' hashes. More columns are ignored; an empty table gives an empty
    result.
    """
    folder = folder or workspace(docs.sparkSession, "imatch")
    n, rows = with_next(docs)
    chars = F.length("text")
    cut = F.expr("length(text) div 4").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - cut), F.substring("__next", F.lit(1), cut))
    rows = rows.withColumn("n_chars", chars.cast("long")).withColumn("__edited", edited)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "__d", "__t", "__nd", "__nt", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        F.xxhash64("__edited").alias("__et"), sampled(F.col("text")).alias("a"), sampled(F.col("__edited")).alias("e"),
    )
    rows = written(rows, folder, "terms")
    each = rows.select("row", F.explode(F.array_union("a.terms", "e.terms")).alias("h"))
    known = each.join(lexicon(docs, n), "h", "left_semi").groupBy("row").agg(F.collect_list("h").alias("known"))
    met = rows.join(known, "row", "left")
    in_lexicon = lambda t: F.array_intersect(t, F.coalesce("known", F.array().cast("array<bigint>")))
    for x, whole in (("a", "__t"), ("e", "__et")):
        met = met.withColumn(f"{x}_by", F.col(f"{x}.by")).withColumn(f"{x}_signs", signatures(in_lexicon(F.col(f"{x}.terms")), F.col(f"{x}.by")))
        met = met.withColumn(f"{x}_print", as_string(F.col(f"{x}_by"), F.col(f"{x}_signs"), F.col(whole)))
    met = written(met.drop("a", "e", "known", "row", "__et"), folder, "fingerprints")
    of = met.groupBy(F.col("__d").alias("__nd"), F.col("__t").alias("__nt")).agg(*(F.first(c).alias(f"n{c}") for c in ("a_by", "a_signs", "a_print")))
    out = met.join(of, ["__nd", "__nt"], "left")
    near = lambda x: likeness(F.col("a_by"), F.col("a_signs"), F.col("a_print"), *(F.col(f"{x}_{c}") for c in ("by", "signs", "print")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("a_print").alias("fingerprint"), F.col("e_print").alias("edited_fingerprint"),
        near("e").alias("near_edited"), near("na").alias("near_next"),
    )
