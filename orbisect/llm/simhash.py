"""Operator 7: near-duplicates by SimHash and multi-index hashing.

Fingerprints of 64 bits are cut in two segments of 32. Two that differ in at most three bits differ in at most one bit of
some segment, so each fingerprint looks up the values within one bit of each of its segments (33 a segment) in a table of
exact segments, and the whole distance of what it meets is verified. Only distinct fingerprints are looked up. A segment
value that very many distinct fingerprints share is cut once more, by the same rule, on its other segment.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected
from ..session import removed
from .common import DOC, held, identity, workspace, written

SEED = 42
#: Segment values that more distinct fingerprints than this share are cut once more.
CROWDED = 256


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than `size` are one shingle."""
    w = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, "<u8")
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    n = max(1, len(w) - size + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(w) - n :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), "<u8", n)


def shingle_set(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of the shingles as sorted signed longs."""
    return np.unique(shingle_hashes(text, size, seed).view("<i8"))


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """Each bit is 1 if set in over half of the hashes of the text's shingles of `size` words, repeats included."""
    h = shingle_hashes(text, size, seed)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and fp, the fingerprint as a signed long."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = [fingerprint(t.as_py(), size) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def segment(fp: Column, k: int, bits: int = 32) -> Column:
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1))


def ball(value: Column, bits: int) -> Column:
    """value and all that differ from it in one bit."""
    flips = F.array(*(F.lit(b) for b in [0, *(1 << i for i in range(bits))]))
    return F.explode(F.transform(flips, lambda b: value.bitwiseXOR(b.cast("long"))))


def looked_up(fps: DataFrame, folder: str, most: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most `most` (3 or fewer) bits."""
    if not 0 <= most <= 3:
        raise ValueError("two segments hold for distances up to 3")
    segments = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), segment(F.col("fp"), k).alias("v"), segment(F.col("fp"), 1 - k).alias("rest")) for k in (0, 1))))
    table = fps.select("fp", segments.alias("s")).select("fp", "s.*")
    probes = table.select("fp", "k", "rest", ball(F.col("v"), 32).alias("v"))
    key = ["k", "v"]
    full = written(table.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select(*key), folder, "crowded")

    def pairs(probe: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
        p, t = probe.select(*on, F.col("fp").alias("a")), held.select(*on, F.col("fp").alias("b"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
        return p.join(t, on).where((F.col("a") < F.col("b")) & near).select("a", "b")

    halves = lambda rest: F.explode(F.array(*(F.struct(F.lit(j).alias("j"), segment(rest, j, 16).alias("w")) for j in (0, 1))))
    cut = lambda df: df.join(full, key, "left_semi").select("fp", *key, halves(F.col("rest")).alias("h")).select("fp", *key, "h.*")
    again = cut(probes).select("fp", *key, "j", ball(F.col("w"), 16).alias("w"))
    plain = pairs(probes.join(full, key, "left_anti"), table.join(full, key, "left_anti"), key)
    return plain.unionByName(pairs(again, cut(table), [*key, "j", "w"]))


def grouped(docs: DataFrame, size: int = 3, most: int = 3, folder: str | None = None) -> DataFrame:
    """doc_id, th, fp, root and component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included; root names the same group by its
    least fingerprint. A text without words has fingerprint zero and links like any other; null texts are empty.
    Repeated rows, and rows with equal doc_ids, are rows each. A null doc_id never is a component_id, but where a group
    has no other. More columns are ignored; an empty table gives an empty result.
    """
    folder = folder or workspace(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs, size), folder, "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "distinct")
    roots = connected(looked_up(distinct.select("fp"), folder, most), folder)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A group's least doc_id is the least of its fingerprints'; only groups of several fingerprints are summed up.
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root")
    return rows.join(classes, "fp").select("doc_id", "th", "fp", "root", "component_id")


# Near copies at a similarity of shingle sets, beyond what a few bits of 64 can hold: met by shared shingles, told apart by
# the whole distance of long fingerprints, and by the sets themselves where that leaves room for doubt


#: 64-bit words of a long fingerprint.
WORDS = 48
#: Odd constants that spread one hash over many words (the golden ratio's fraction and two mixing primes, fixed values).
SPREAD, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Each byte's bits as the bytes of a long, so that sums of up to 255 of them count each bit.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
#: Documents about, and shingles at most, whose counts give the order of look-ups.
SAMPLE, COMMON = 8192, 200_000
#: Prefix shingles that more sets than this share are left to a second look-up.
SHARED = 512
#: Sets of up to so many shingles go along whole; where one of fewer than SMALL takes part, fingerprints are held against a
#: looser bound, as they don't follow the angle as closely, and the sets decide.
SMALL, WHOLE = 50, 64
#: How far the estimate by so many first words may lie below a pair's similarity: over 4.5 standard deviations at 0.8.
STEPS = ((1, 0.58), (16, 0.12), (WORDS, 0.07))
#: What small sets are allowed more, and how far above the bound a pair needs no comparison of its sets.
SLACK_SMALL, SURE = 0.1, 0.07


def long_fingerprint(text: str | None, size: int = 5, words: int = WORDS, seed: int = SEED) -> tuple[list[int], int]:
    """The SimHash of a text's set of shingles over `words` 64-bit words as signed longs, and the set's size."""
    return sketched(shingle_set(text, size, seed), words)


def sketched(hashes: np.ndarray, words: int = WORDS) -> tuple[list[int], int]:
    """A set's SimHash over many words, whose hashes are mixed from the one of each shingle; a bit that half of them set is set."""
    n = len(hashes)
    if not n:
        return [0] * words, 0
    counts, h = np.zeros((words, 64), np.int64), hashes.view("<u8")
    spread = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(SPREAD))[:, None]
    for i in range(0, n, 255 * 32):
        x = h[None, i : i + 255 * 32] + spread
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        x ^= x >> np.uint64(31)
        sums = np.add.reduceat(BITS[x.view(np.uint8).reshape(words, -1, 8)], np.arange(0, x.shape[1], 255), axis=1)
        counts += sums.view(np.uint8).reshape(words, -1, 64).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts >= n, axis=1, bitorder="little").reshape(-1).view("<i8").tolist(), n


def differing(a: Column, b: Column, words: int = WORDS) -> Column:
    """How many bits of the first words of two fingerprints differ."""
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    if words == 1:
        return apart(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    return F.aggregate(F.zip_with(F.slice(a, 1, words), F.slice(b, 1, words), apart), F.lit(0), lambda s, x: s + x)


def estimated(a: Column, na: Column, b: Column, nb: Column, words: int = WORDS) -> Column:
    """The similarity (shared shingles over all) that two fingerprints' distance stands for: their angle gives the cosine,
    which with both sizes gives the shared shingles."""
    shared = F.cos(differing(a, b, words) * (np.pi / (64 * words))) * F.sqrt(na * nb)
    return shared / (na + nb - shared)


def most_apart(least: float, words: int) -> int:
    """How many bits may differ, whatever the sizes, where the estimate is to be `least` or more."""
    return math.floor(64 * words * math.acos(2 * least / (1 + least)) / math.pi + 1e-9)


def prefix(n: Column, least: float) -> Column:
    """How many of n shingles, the first in any one order of all shingles, hold one that a set alike by `least` shares."""
    return (n - F.ceil(n * least - 1e-9) + 1).cast("int")


def needed(na: Column, nb: Column, least: float) -> Column:
    """The least number of shared shingles that makes two sets of na and nb alike by `least`."""
    return F.ceil((na + nb) * (least / (1 + least)) - 1e-9)


SIGNATURES = "doc_id long, th long, h1 long, h2 long, n int, fp array<long>, small array<long>, keys array<long>"


def common_shingles(docs: DataFrame, size: int, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of up to `most` shingles that several of about `sample` documents drawn by hash hold.

    They only decide the order in which sets are looked up. Any order finds all pairs; one that puts common shingles last
    meets few others."""
    every = max(1, docs.count() // sample)
    drawn = docs.select("text").where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("drawn")), F.lit(every)) == 0)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for t in part.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size), pa.int64())], ["t"])

    counts = drawn.mapInArrow(run, "t long").groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    found = sorted((r.t, r.c) for r in counts.orderBy(F.desc("c"), "t").limit(most).collect())
    return np.array([t for t, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def in_order(s: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's shingles by how common they are, ties by hash."""
    if not len(hashes) or not len(s):
        return s
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    return s[np.lexsort((s, np.where(hashes[at] == s, counts[at], 0)))]


def signatures(docs: DataFrame, size: int, least: float) -> DataFrame:
    """doc_id, th, h1 and h2 (a hash of the set of shingles), n shingles, fp (the long fingerprint), small (the set
    itself where it is small) and keys, the prefix of the set in the order of common_shingles()."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for t in part.column("text"):
                s = shingle_set(t.as_py(), size)
                fp, n = sketched(s)
                keys = in_order(s, *held.value)[: n - math.ceil(n * least - 1e-9) + 1]
                rows.append((*np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist(), n, fp, s[: WHOLE * (n <= WHOLE)], keys))
            kinds = pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *made], ["doc_id", "th", "h1", "h2", "n", "fp", "small", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.mapInArrow(run, SIGNATURES)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """node and s, the sorted set of shingles, of rows (node, text)."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 1000):
                some = part.slice(k, 1000)
                sets = [shingle_set(t.as_py(), size) for t in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node long, s array<long>")


def side(df: DataFrame, k: int) -> DataFrame:
    """df with k after the names of its columns."""
    return df.select(*(F.col(c).alias(f"{c}{k}") for c in df.columns))


def may_be(least: float) -> Column:
    """Whether the distance of two sets (n1 and n2 shingles, fingerprints fp1 and fp2) allows for a similarity of `least`:
    first that of one word, which most pairs fail, at last the whole one. Where both are small, the sets decide."""
    n1, n2, a, b = F.col("n1"), F.col("n2"), F.col("fp1"), F.col("fp2")
    sized = F.least(n1, n2) >= F.ceil(F.greatest(n1, n2) * least - 1e-9)
    own = F.size(F.array_intersect("small1", "small2")) >= needed(n1, n2, least)
    steps = [F.when(F.least(n1, n2) < SMALL, most_apart(least - slack - SLACK_SMALL, words)).otherwise(most_apart(least - slack, words)) for words, slack in STEPS]
    near = reduce(and_, (differing(a, b, words) <= most for (words, _), most in zip(STEPS, steps, strict=True)), sized)
    return near & F.when(F.greatest(n1, n2) <= WHOLE, own).otherwise(True)


def close(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs (a, b) those that may be alike by `least`, with the estimate e (1 where that
    is certain)."""
    of = nodes.select("node", "n", "fp", "small")
    both = pairs.join(side(of, 1).withColumnRenamed("node1", "a"), "a").join(side(of, 2).withColumnRenamed("node2", "b"), "b")
    return both.where(may_be(least)).select("a", "b", F.when(F.expr(f"greatest(n1, n2) <= {WHOLE}"), 1.0).otherwise(estimated(F.col("fp1"), F.col("n1"), F.col("fp2"), F.col("n2"))).alias("e"))


def stars(cells: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each node of a cell (t, node) with the one that is the cell's centre."""
    centres = cells.groupBy("t").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("c")).select("t", F.col("c.node").alias("centre"))
    met = cells.join(centres, "t").where("node <> centre")
    return met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def across(cells: DataFrame, nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a cell (t, node, i), lie in different components of `roots`, and may be alike
    by `least`. t is the i-th of each one's shingles, so that enough must be left to share. What isn't alike isn't made into
    rows, and, where cells tell the shared shingles before t, each pair is one row: in the first cell that both share."""
    named = cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
    rows = named.join(several, "t", "left_semi").join(nodes.select("node", "n", "fp", "small"), "node")
    # Sizes that may go together lie in the same of these classes, or that of the larger set in the next one.
    kind = F.floor(F.ln("n") / math.log(1.0001 / least))
    smaller = rows.where(F.expr("n - i") >= needed(F.col("n"), F.col("n"), least)).withColumn("g", F.explode(F.array(kind, kind + 1)))
    enough = F.least(F.expr("n1 - i1"), F.expr("n2 - i2")) >= needed(F.col("n1"), F.col("n2"), least)
    more = ["before"] if "before" in cells.columns else []
    keyed = lambda df, k: df.select("t", "g", *(F.col(c).alias(f"{c}{k}") for c in ("node", "root", "i", "n", "fp", "small", *more)))
    met = keyed(smaller, 1).join(keyed(rows.withColumn("g", kind), 2), ["t", "g"])
    met = met.where(F.expr("root1 <> root2 AND (n1 < n2 OR n1 = n2 AND node1 < node2)")).where(enough).where(may_be(least))
    if more:
        met = met.where(~F.arrays_overlap("before1", "before2"))
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def ranked(sets: DataFrame, least: float) -> DataFrame:
    """t, node, i, before: each set's prefix in the order of how many of the sets hold a shingle. Those that one set alone holds come
    first and meet nothing; what many share comes last, and is in no prefix where the sets differ enough elsewhere."""
    held = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("t"))
    counts = held.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    ordered = held.join(counts, "t").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("by"))
    ordered = ordered.withColumn("alone", F.expr("n - size(by)")).withColumn("take", prefix(F.col("n"), least) - F.col("alone"))
    return ordered.where("take > 0").select("node", "alone", "by", F.posexplode(F.slice("by", 1, F.col("take")))).selectExpr("col.t AS t", "node", "alone + pos AS i", "slice(by.t, 1, pos) AS before")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets share enough."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"{x}s"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(F.size(F.array_intersect("as", "bs")) >= needed(F.size("as"), F.size("bs"), least)).select("a", "b")


@dataclass(frozen=True)
class Found:
    """Distinct sets of shingles as rows (node, n, fp, small, keys), and what gives (node, s), the whole sets of a table of nodes."""

    nodes: DataFrame
    sets_of: Callable[[DataFrame], DataFrame]


def similar(found: Found, folder: str, least: float, crowded: int = SHARED) -> DataFrame:
    """Links (a, b) of nodes, with the same components as all pairs of a similarity of `least` or more.

    Whatever one order all shingles are put in, two sets that are so alike share one among the first of each (a fifth, at
    0.8), so looking these up meets every pair, at every number of texts. The first order is by counts in a sample,
    then by hash. A shingle that more than `crowded` sets share there is left out, and the sets that have it are looked up
    once more in the order of all their counts. All sets that share a shingle are compared with one of them first, and then only with those that the
    sure links of these comparisons left in other components. The whole distance of the fingerprints decides, and the
    sets themselves where it lies near the bound.
    """
    nodes = found.nodes
    keys = nodes.select("node", F.posexplode("keys")).selectExpr("col AS t", "node", "pos AS i")
    shared = keys.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    cells = written(keys.join(shared, "t").select("t", "node", "i", F.least("c", F.lit(crowded + 1)).cast("int").alias("c")), folder, "cells")
    first = written(close(stars(cells), nodes, least), folder, "stars")
    sure = first.where(F.col("e") >= least + SURE).select("a", "b")
    roots = written(connected(sure, f"{folder}/sure"), folder, "sure-roots")
    second = across(cells.where(F.col("c").between(3, crowded)), nodes, roots, least)  # of two, one is the centre
    own = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}r"))
    doubtful = first.where(F.col("e") < least + SURE).select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    doubtful = doubtful.where(F.coalesce("ar", "a") != F.coalesce("br", "b")).select("a", "b")
    doubtful = written(doubtful.unionByName(second).distinct(), folder, "doubtful")
    crowd = written(cells.where(F.col("c") > crowded).select("node").distinct(), folder, "crowd")
    asked = doubtful.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd).distinct()
    sets = written(found.sets_of(written(asked, folder, "asked")), folder, "sets")
    again = written(ranked(sets.join(crowd, "node", "left_semi"), least), folder, "ranked")
    links = written(sure.unionByName(verified(doubtful, sets, least)), folder, "links")
    roots = written(connected(links, f"{folder}/links-of"), folder, "roots")
    third = written(across(again, nodes, roots, least), folder, "across")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(third, sets, least))


def grouped_by_similarity(docs: DataFrame, size: int = 5, least: float = 0.8, folder: str | None = None) -> DataFrame:
    """doc_id, th, root, component_id as grouped(), where texts link whose sets of shingles share `least` or more of all
    that they hold. Texts without words are alike; texts of equal sets always link.

    Sets are known by 64-bit hashes, and only those that fingerprints leave in doubt, or crowds, are made a second time;
    see similar(). Null texts are empty, null doc_ids never are a component_id but where a group has no other, rows that
    repeat are rows each, more columns are ignored, and an empty table gives an empty result."""
    folder = folder or workspace(docs.sparkSession, "similar")
    every = written(signatures(docs, size, least), folder, "signatures")
    same = ["h1", "h2"]
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__d"), F.col("th").alias("__t")))
    distinct = every.groupBy(*same).agg(*(F.first(c).alias(c) for c in ("n", "fp", "small", "keys")), F.min("doc_id").alias("least"), first.alias("first"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), folder, "distinct")
    rows = written(every.select("doc_id", "th", *same), folder, "rows")
    removed(docs.sparkSession, f"{folder}/signatures")

    def sets_of(asked: DataFrame) -> DataFrame:
        texts = docs.select(*identity(), "text").join(distinct.select("node", "first.*").join(asked, "node", "left_semi"), list(DOC))
        # Rows that repeat a doc_id and a text are one; they have met already.
        texts = texts.withColumn("__n", F.row_number().over(Window.partitionBy(*DOC).orderBy(F.lit(0)))).where("__n = 1")
        return shingle_sets(texts, size)

    links = similar(Found(distinct.where("n > 0").select("node", "n", "fp", "small", "keys"), sets_of), folder, least)
    roots = connected(links, folder)
    named = distinct.select(*same, "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.select(*same, "root").join(least_id, "root"), folder, "classes")
    return rows.join(classes, same).select("doc_id", "th", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each group of `found`: that whose doc_id is the component_id; of rows that tie, the first by
    text hash, then by the hash of all their columns."""
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("th"))).where("n = 1")
    stay = first.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__d"), F.col("th").alias("__t"))
    kept = held(docs).join(stay, list(DOC), "left_semi")
    # Rows that repeat a doc_id and a text are alike to the links: one of them stays. The text moves once for both steps.
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(*DOC).orderBy(F.xxhash64("__doc")))).where("__n = 1")
    return kept.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))
