"""Components of crystals: bonds that cross cell faces, so that each atom has a molecule and the cell it is taken from.

Alternating large and small stars, as in components.py, whose links carry an integer vector: the cell of one end relative
to the other's. Along a path the vectors add up, so a star's links say in which cell each node lies relative to its root.
Two ways to one node whose sums differ make a loop, a translation that maps the component onto itself: it is endless, and
the rank of its loops says along how many directions. Links never leave a structure, so those of one with up to ROW links
are one row, and a walk over them finds the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import workspace, written
from .structures import moved, with_mass, wrapped

CELL = ("na", "nb", "nc")
STEP = ("a", "b", "c")


def step(sign: int, *vectors: str) -> list[Column]:
    """The difference of two vectors (columns or structs of a, b, c), or one with a sign."""
    if len(vectors) == 1:
        return [(F.col(f"{vectors[0]}{c}") * sign).alias(c) for c in STEP]
    return [(F.col(f"{vectors[0]}{c}") - F.col(f"{vectors[1]}{c}")).alias(c) for c in STEP]


def least_neighbour(edges: DataFrame) -> DataFrame:
    """s, u and m: the least neighbour v of u with its vector."""
    return edges.groupBy("s", "u").agg(F.min(F.struct("v", *STEP)).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.unionByName(edges.select("s", F.col("v").alias("u"), F.col("u").alias("v"), *step(-1, "")))
    own = F.struct(F.col("u").alias("v"), *(F.lit(0).alias(c) for c in STEP))
    least = least_neighbour(both).withColumn("m", F.when(F.col("m.v") < F.col("u"), F.col("m")).otherwise(own))
    met = both.where("v > u").join(least, ["s", "u"])
    return met.select("s", F.col("v").alias("u"), F.col("m.v").alias("v"), *step(1, "m.", "")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these; links of a node with itself are loops."""
    least = least_neighbour(edges)
    met = edges.join(least, ["s", "u"]).select("s", F.col("v").alias("u"), F.col("m.v").alias("v"), *step(1, "m.", ""))
    return met.where("u <> v OR a <> 0 OR b <> 0 OR c <> 0").unionByName(least.select("s", "u", "m.v", *(f"m.{c}" for c in STEP))).distinct()


def connected(links: DataFrame, folder: str, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Of links (struct_id, i, j, na, nb, nc: j lies in that cell relative to i's), the nodes (s, node, root, a, b, c: the
    node's cell relative to its root's, root the least node) and the loops (s, node, a, b, c).

    Each round is written to the shared folder, which cuts the lineage; the number of rounds grows with the logarithm of
    the longest path. Every link becomes one link a round, so the links never grow beyond links and nodes.
    """
    turned = F.col("i") < F.col("j")
    vector = [F.when(turned, -F.col(n)).otherwise(F.col(n)).cast("int").alias(c) for c, n in zip(STEP, CELL, strict=True)]
    edges = links.select(F.col("struct_id").alias("s"), F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"), *vector).distinct()
    edges, before = written(edges.where("u <> v OR a <> 0 OR b <> 0 OR c <> 0"), folder, "links-0"), None
    for k in range(1, most_rounds + 1):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("s", "u", "v", *STEP).cast("decimal(20,0)")).alias("h")).first()
        plain, loops = edges.where("u <> v"), edges.where("u = v")
        if (state["n"], state["h"]) == before:
            roots = plain.select("s", F.col("v").alias("node"), F.col("v").alias("root"), *(F.lit(0).alias(c) for c in STEP)).distinct()
            nodes = plain.select("s", F.col("u").alias("node"), F.col("v").alias("root"), *step(-1, "")).unionByName(roots)
            return nodes, loops.select("s", F.col("u").alias("node"), *STEP)
        before = (state["n"], state["h"])
        edges = written(small_star(large_star(plain)).unionByName(loops).distinct(), folder, f"links-{k}")
    raise RuntimeError(f"components aren't found after {most_rounds} rounds")


def rank(vectors: DataFrame, *by: str) -> DataFrame:
    """`by` and rank: along how many directions the integer vectors (a, b, c) of a group go. The rank of their products'
    sum, which is exact while it is below 10^6 (distinct vectors of up to a hundred cells)."""
    names = {f"{x}{y}": F.sum((F.col(x) * F.col(y)).cast("long")).alias(f"{x}{y}") for x, y in (("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("a", "c"), ("b", "c"))}
    sums = vectors.distinct().groupBy(*by).agg(*names.values())
    aa, bb, cc, ab, ac, bc = (F.col(n) for n in names)
    minors = aa * bb - ab * ab + aa * cc - ac * ac + bb * cc - bc * bc
    det = aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)
    found = F.when(det != 0, 3).when(minors != 0, 2).when(aa + bb + cc != 0, 1).otherwise(0)
    return sums.select(*by, found.alias("rank"))


def starred(links: DataFrame, folder: str) -> DataFrame:
    """struct_id, atom_idx, root, a, b, c and rank of all atoms of links, by stars: structures of any size."""
    nodes, loops = connected(links, folder)
    nodes = nodes.withColumnsRenamed({"s": "struct_id", "node": "atom_idx"})
    endless = rank(loops.withColumnsRenamed({"s": "struct_id", "node": "atom_idx"}).join(nodes.select("struct_id", "atom_idx", "root"), ["struct_id", "atom_idx"]).select("struct_id", "root", *STEP), "struct_id", "root")
    # A loop at an atom without other links has no node yet.
    lone = rank(loops.select(F.col("s").alias("struct_id"), F.col("node").alias("atom_idx"), *STEP), "struct_id", "atom_idx").join(nodes, ["struct_id", "atom_idx"], "left_anti")
    found = nodes.join(endless, ["struct_id", "root"], "left").select("struct_id", "atom_idx", "root", *STEP, "rank")
    return found.unionByName(lone.select("struct_id", "atom_idx", F.col("atom_idx").alias("root"), *(F.lit(0).alias(c) for c in STEP), "rank"))


def walked(links: DataFrame) -> DataFrame:
    """starred() of structures whose links fit in a row."""
    rows = links.groupBy("struct_id").agg(F.collect_list(F.struct("i", "j", *(F.col(c).cast("int").alias(c) for c in CELL))).alias("links"))
    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ends = part.column("links")
            flat, sizes = ends.flatten(), ends.value_lengths().to_numpy()
            columns = np.column_stack([flat.field(k).to_numpy() for k in range(5)]) if len(flat) else np.zeros((0, 5), int)
            found, own = [], []
            for k, some in enumerate(np.split(columns, np.cumsum(sizes)[:-1])):
                rows = walk(some.tolist())
                found += rows
                own += [k] * len(rows)
            each = list(zip(*found, strict=True)) if found else [[]] * 6
            ids = part.column("struct_id").take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, flat.field(0).type) for c in each[:2]), *(pa.array(c, pa.int32()) for c in each[2:])], ["struct_id", "atom_idx", "root", *STEP, "rank"])

    return rows.mapInArrow(run, f"struct_id {kinds['struct_id']}, atom_idx {kinds['i']}, root {kinds['i']}, a int, b int, c int, rank int")


def walk(links: list[list[int]]) -> list[tuple[int, ...]]:
    """atom, root, cell relative to the root's, and rank of the component's loops, of one structure's links i, j, na, nb, nc."""
    near: dict[int, list[tuple[int, ...]]] = {}
    for i, j, a, b, c in links:
        near.setdefault(i, []).append((j, a, b, c))
        near.setdefault(j, []).append((i, -a, -b, -c))
    out, seen = [], {}
    for root in sorted(near):
        if root in seen:
            continue
        seen[root], own, loops = (0, 0, 0), [root], set()
        for i in own:
            x, y, z = seen[i]
            for j, a, b, c in near[i]:
                to = (x + a, y + b, z + c)
                if (at := seen.setdefault(j, None)) is None:
                    seen[j] = to
                    own.append(j)
                elif at != to:
                    loops.add((to[0] - at[0], to[1] - at[1], to[2] - at[2]))
        n = int(np.linalg.matrix_rank(np.array(sorted(loops)))) if loops else 0
        out += [(i, root, *seen[i], n) for i in own]
    return out


#: Links of a structure that are walked over in one row.
ROW = 200_000


def molecules(atoms: DataFrame, links: DataFrame, folder: str | None = None, most: int = ROW) -> DataFrame:
    """struct_id, atom_idx, mol_idx, sa, sb, sc and periodicity: molecules numbered by their least atom; the cell from which
    a whole molecule takes each atom, that of its least atom being 0, 0, 0; and along how many directions it is endless.

    links: periodic_bonds(), or bonds of molecules with cells of 0. A component that is endless has no whole molecule: its
    atoms stay in their own cells. Cells are relative to atoms wrapped into the cell, as periodic_bonds() has them. Atoms
    without links are molecules each; links may come from one end or both. Structures of over `most` links go by stars.
    """
    folder = folder or workspace(atoms.sparkSession, "networks")
    links = written(links.select("struct_id", "i", "j", *CELL), folder, "links")
    large = written(links.groupBy("struct_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("struct_id"), folder, "large")
    some = not large.isEmpty()
    nodes = walked(links.join(large, "struct_id", "left_anti") if some else links)
    if some:
        nodes = nodes.unionByName(starred(links.join(large, "struct_id", "left_semi"), folder))
    every = atoms.select("struct_id", "atom_idx").join(nodes, ["struct_id", "atom_idx"], "left").withColumn("root", F.coalesce("root", "atom_idx"))
    periodicity = F.coalesce("rank", F.lit(0))
    number = F.dense_rank().over(Window.partitionBy("struct_id").orderBy("root")) - 1
    cells = [F.when(periodicity > 0, 0).otherwise(F.coalesce(c, F.lit(0))).alias(f"s{c}") for c in STEP]
    return every.select("struct_id", "atom_idx", number.alias("mol_idx"), *cells, periodicity.alias("periodicity"))


def whole(atoms: DataFrame, lattices: DataFrame, found: DataFrame) -> DataFrame:
    """atoms of crystals, wrapped and then moved by whole cells so that each of molecules()' molecules is in one piece, with its
    centre of mass in the cell. Endless components stay where they are wrapped, and so does what has an atom of no known mass."""
    names = list(dict.fromkeys((*atoms.columns, "mass")))
    rows = with_mass(wrapped(atoms, lattices)).select(*names).join(found.select("struct_id", "atom_idx", "mol_idx", "sa", "sb", "sc"), ["struct_id", "atom_idx"])
    rows = rows.join(G.with_reciprocal(lattices), "struct_id")
    lat, rec = G.lattice_columns(), G.lattice_columns("reciprocal")
    by = lambda cells: [sum((n * row[k] for n, row in zip(cells, lat, strict=True)), F.lit(0.0)) for k in range(3)]
    rows = moved(rows, [F.col(n) + d for n, d in zip("xyz", by([F.col(f"s{c}") for c in STEP]), strict=True)])
    own = Window.partitionBy("struct_id", "mol_idx")
    known = F.count("mass").over(own) == F.count("*").over(own)
    rows = rows.withColumns({f"centre_{c}": F.when(known, F.sum(F.col("mass") * F.col(c)).over(own) / F.sum("mass").over(own)) for c in "xyz"})
    # What rounding puts just below a face lies on it.
    out = [F.coalesce(F.floor(G.dot(G.columns("centre_"), r) + 1e-9), F.lit(0)) for r in rec]
    rows = rows.withColumns({f"s{c}": n for c, n in zip(STEP, out, strict=True)})
    return moved(rows, [F.col(n) - d for n, d in zip("xyz", by([F.col(f"s{c}") for c in STEP]), strict=True)]).select(*atoms.columns)
