"""Operator 9: quality rules whose thresholds adapt to each language and source.

Every measure is counted into the bins of a relative-error quantile sketch: bin i holds the values up to GAMMA ** i.
Sketches of equal bins merge by adding counts, so those of a language, and of all documents, come from those of its
sources, and the result doesn't depend on how rows are dealt. Fences are set from a sketch's quartiles and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, words, workspace, written

GAMMA = 1.02
ZERO = -(1 << 20)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Fence:
    """Values of num / den are kept up to q75 + reach * (q75 - q25), or `least` where that is less; two_sided: and down to
    q25 - the same reach. `spread` is the least that q75 - q25 counts as."""

    name: str
    num: str
    den: str
    reach: float
    spread: float
    least: float = 0.0
    two_sided: bool = False


FENCES = (
    Fence("symbols", "n_symbols", "n_words", 6.0, 0.01, 0.2),
    Fence("repeats", "n_repeat_words", "n_words", 6.0, 0.02, 0.4),
    Fence("dup_lines", "n_dup_lines", "n_lines", 6.0, 0.02, 0.6),
    Fence("word_length", "word_chars", "n_words", 8.0, 0.3, 0.0, True),
)
#: A sketch of fewer documents than this gives no fences; the language's or, failing that, the one of all does.
LEAST_DOCS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """How many words lie in a three-word window found twice or more; windows are told apart by 64-bit hashes."""
    n = F.size(w)
    hashes = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j, d: F.coalesce(x["h"] == F.get(s, j + d)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"]))

        step = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(let(let(pairs, places), step), F.lit(0), lambda a, x: a + x)

    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0))


def measures(text: Column) -> Column:
    """A struct of COUNTS for a text; null and empty texts have zeros."""

    def counted(w: Column) -> Column:
        lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        long = lambda c, name: c.cast("long").alias(name)
        return F.struct(
            long(F.size(w), "n_words"),
            long(F.length(F.array_join(w, "")), "word_chars"),
            long(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")), "n_symbols"),
            long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
            long(repeat_words(w), "n_repeat_words"),
            long(F.size(lines), "n_lines"),
        )

    return let(words(text), counted)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and `m`, the measures: no text."""
    return docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m"))


def sketches(rows: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Bin counts of each fence's measure by language and source, over the documents that pass the base rules."""
    value = lambda f: F.col(f"m.{f.num}") / F.greatest(F.col(f"m.{f.den}"), F.lit(1))
    each = F.explode(F.array(*(F.struct(F.lit(f.name).alias("fence"), value(f).alias("x")) for f in fences)))
    bins = rows.where(~base_failed(F.col("m"))).select("lang", "source", each.alias("e"))
    bin_of = F.when(F.col("e.x") > 0, F.ceil(F.log("e.x") / F.log(F.lit(GAMMA)))).otherwise(F.lit(ZERO)).cast("long")
    return bins.groupBy("lang", "source", F.col("e.fence").alias("fence"), bin_of.alias("bin")).agg(F.count("*").alias("n"))


def fences_of(bins: DataFrame, fences: tuple[Fence, ...] = FENCES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source and columns low_<fence>, high_<fence> for each language and source in the sketches."""
    levels = bins.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    key = [F.when(F.col("level") >= 1, F.col("lang")).alias("lang"), F.when(F.col("level") == 2, F.col("source")).alias("source")]
    merged = levels.groupBy("level", *key, "fence", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "lang", "source", "fence")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bin")))
    value = lambda b: F.when(b == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b))
    quartiles = upto.groupBy("level", "lang", "source", "fence").agg(F.max("all").alias("docs"), value(at(1)).alias("q1"), value(at(3)).alias("q3"))

    def bounds(f: Fence) -> list[Column]:
        own = F.col("fence") == f.name
        reach = f.reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(f.spread))
        low = F.col("q1") - reach if f.two_sided else F.lit(None).cast("double")
        return [F.max(F.when(own, low)).alias(f"low_{f.name}"), F.max(F.when(own, F.greatest(F.col("q3") + reach, F.lit(f.least)))).alias(f"high_{f.name}")]

    named = [f"{side}_{f.name}" for f in fences for side in ("low", "high")]
    rows = quartiles.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *(b for f in fences for b in bounds(f)))
    # A group's own fences, its language's, and those of all; the window holds a row for each group.
    packed = rows.select("level", "lang", "source", F.struct("docs", *named).alias("b"))
    packed = packed.withColumn("b0", F.max(F.when(F.col("level") == 0, F.col("b"))).over(Window.partitionBy()))
    finest = packed.where("level = 2").select(F.col("lang").alias("lang2"), F.col("source").alias("source2"), F.col("b").alias("b2"), "b0")
    langs = packed.where("level = 1").select(F.col("lang").alias("lang1"), F.col("b").alias("b1"))
    by_lang = finest.join(langs, F.col("lang2").eqNullSafe(F.col("lang1")), "left")
    enough = lambda k: F.col(f"b{k}.docs") >= least_docs
    chosen = F.when(enough(2), F.col("b2")).when(enough(1), F.col("b1")).otherwise(F.col("b0"))
    return by_lang.select(F.col("lang2").alias("lang"), F.col("source2").alias("source"), chosen.alias("b")).select("lang", "source", *(f"b.{c}" for c in named))


def inside(m: Column, fence_row: Callable[[str], Column], fences: tuple[Fence, ...] = FENCES) -> Column:
    """Whether all measures lie within their fences; a missing fence holds nothing back."""
    ok = F.lit(True)
    for f in fences:
        x = m[f.num] / F.greatest(m[f.den], F.lit(1))
        ok = ok & F.coalesce(x <= fence_row(f"high_{f.name}"), F.lit(True))
        ok = ok & F.coalesce(x >= fence_row(f"low_{f.name}"), F.lit(True))
    return ok


def with_verdict(rows: DataFrame, m: str, lang: str, source: str, thresholds: DataFrame, name: str) -> DataFrame:
    """rows with the boolean `name`; m: their column of measures."""
    t = thresholds.select(*(F.col(c).alias(f"__{c}") for c in thresholds.columns))
    on = F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source"))
    # One condition over both sides: a conjunct on measures alone would be pushed below and compute them once more.
    verdict = F.when(base_failed(F.col(m)), F.lit(False)).otherwise(inside(F.col(m), lambda c: F.col(f"__{c}")))
    return rows.join(t, on, "left").withColumn(name, verdict).drop(*t.columns)


def rated(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs (doc_id, text, lang, source).

    Null and empty texts have no words and fail the base rules; null languages and sources are groups of their own;
    repeated rows are rated each; more columns are ignored. An empty table gives an empty result.
    """
    folder = folder or workspace(docs.sparkSession, "quality")
    rows = written(measured(docs), folder, "measures")
    thresholds = written(fences_of(sketches(rows)), folder, "fences")
    out = with_verdict(rows, "m", "lang", "source", thresholds, "kept")
    return out.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in COUNTS[:5]), base_failed(F.col("m")).alias("base_failed"), "kept")


def filtered(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of docs that rated() keeps, with all their columns. Only measures and fences are written; no text moves."""
    folder = folder or workspace(docs.sparkSession, "quality")
    thresholds = written(fences_of(sketches(written(measured(docs), folder, "measures"))), folder, "fences")
    rows = docs.select(F.struct("*").alias("__doc"), "lang", "source", measures(F.col("text")).alias("__m"))
    kept = with_verdict(rows, "__m", "lang", "source", thresholds, "__kept").where("__kept")
    return kept.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))
