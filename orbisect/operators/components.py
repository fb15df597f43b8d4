"""Connected components of a table of links, by alternating large and small stars; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b), root the least node reachable.

    Each round is written to the shared folder, which cuts the lineage. The number of rounds grows with the logarithm
    of the longest path; if most_rounds don't do, it raises.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = written(edges, folder, "links-0"), None
    for k in range(1, most_rounds + 1):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = (state["n"], state["s"])
        edges = written(small_star(large_star(edges)), folder, f"links-{k}")
    raise RuntimeError(f"components aren't found after {most_rounds} rounds")


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, F.col("u") == F.col("c"))
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
