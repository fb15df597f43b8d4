"""Duplicate crystals: lattices first, in a join over bands, and the superposition of molecule clusters last.

lattices.py says why the join misses no pair of lattices within the strain. Clusters are made once a structure; only the
pairs that the join leaves carry them into the costly comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workspace, written
from . import dedup, lattices, local, pairs


def alike(structures: DataFrame, strain: float = 0.1, folder: str | None = None) -> DataFrame:
    """id1, id2, value: pairs of one formula, in any two cells, whose lattices are within a strain of each other; value is the
    largest relative difference of lattice measures. Where structures say which of them is_new, one of a pair is."""
    kinds, members = copies(structures, folder or workspace(structures.sparkSession, "lattices"))
    return dedup.expanded(near_kinds(kinds, strain), members)


def copies(structures: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Kinds (struct_id, elements, geometry, lattice, is_new, low, high), one for all structures that are equal to the last digit,
    and members (kind, id, is_new). A kind's id is its content's digest, is_new whether any member is, and low and high are
    its members' least and largest id."""
    is_new = F.col("is_new") if "is_new" in structures.columns else F.lit(True)
    what = F.struct("elements", "geometry", "lattice")
    rows = structures.select(F.sha2(F.to_json(what), 256).alias("kind"), F.col("struct_id").alias("id"), is_new.alias("is_new"), what.alias("what"))
    kinds = rows.groupBy("kind").agg(F.first("what").alias("what"), F.max("is_new").alias("is_new"), F.min("id").alias("low"), F.max("id").alias("high"))
    kinds = kinds.select(F.col("kind").alias("struct_id"), "what.*", "is_new", "low", "high")
    return written(kinds, folder, "kinds"), written(rows.drop("what"), folder, "members")


def near_kinds(kinds: DataFrame, strain: float, folder: str | None = None) -> DataFrame:
    """kind1, kind2, value: kinds whose lattices are alike, both ways and each with itself, where a member of the first can come
    before one of the second."""
    folder = folder or workspace(kinds.sparkSession, "near")
    measures = written(lattices.measured(kinds, folder), folder, "measures")
    near = lattices.alike(measures, strain).select(F.col("id1").alias("kind1"), F.col("id2").alias("kind2"), "value")
    own = measures.where("is_new").select(F.col("struct_id").alias("kind1"), F.col("struct_id").alias("kind2"), F.lit(0.0).alias("value"))
    every = near.unionByName(near.select(F.col("kind2").alias("kind1"), F.col("kind1").alias("kind2"), "value")).unionByName(own)
    ends = lambda n, c: kinds.select(F.col("struct_id").alias(f"kind{n}"), c)
    return every.join(ends(1, "low"), "kind1").join(ends(2, "high"), "kind2").where("low < high").select("kind1", "kind2", "value")


def duplicates(structures: DataFrame, strain: float = 0.1, rmsd: float | None = 0.5, nn: int = 8) -> DataFrame:
    """op, id1, id2, value, is_match for the pairs that alike() leaves: is_match says whether the cluster displacement is below
    rmsd, and value is the displacement of those where it is. Without rmsd the lattices decide, and value is their strain.

    Cells may be strained, permuted, skewed, shifted, or hold several primitive ones; a pair whose lattices differ by more
    than the strain is no match, whatever its clusters are. Structures that are equal to the last digit are measured and
    compared once, and pairs are listed from that.
    """
    folder = workspace(structures.sparkSession, "duplicates")
    kinds, members = copies(structures, folder)
    near = near_kinds(kinds, strain, folder)
    if rmsd is None:
        return pairs.scored(dedup.expanded(near, members), "duplicate", F.col("value"), F.lit(True))
    near = written(near.select(F.col("kind1").alias("id1"), F.col("kind2").alias("id2")), folder, "near")
    some = near.select(F.explode(F.array("id1", "id2")).alias("struct_id")).distinct()
    own = written(local.clusters(kinds.join(some, "struct_id", "left_semi"), nn, hydrogens=True), folder, "clusters")
    met = near.join(own.select(F.col("struct_id").alias("id1"), "first", "first_sizes"), "id1").join(own.select(F.col("struct_id").alias("id2"), "others", "others_sizes"), "id2")
    found = written(local.cluster_displacements(met, rmsd), folder, "found").withColumnsRenamed({"id1": "kind1", "id2": "kind2"})
    return pairs.scored(dedup.expanded(found, members), "duplicate", F.when(F.col("value") < rmsd, F.col("value")), F.col("value") < rmsd)


def unique(structures: DataFrame, order: str = "struct_id", keep_single: bool = True, compare: Callable[[DataFrame], DataFrame] = duplicates) -> DataFrame:
    """leader, member: the structures that lead in order and what each stands for. compare: structures to scored pairs."""
    folder = workspace(structures.sparkSession, "unique")
    links = written(compare(structures).where("is_match").select("id1", "id2"), folder, "links")
    nodes = structures.select(F.col("struct_id").alias("id"), F.col(order).alias("ord"))
    return dedup.unique(nodes, links, keep_single, folder)
