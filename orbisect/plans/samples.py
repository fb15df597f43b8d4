"""Structures made from the driver's tables: orders as clouds of atoms, suppliers as molecules and crystals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.structures import renumbered
from ..session import table

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")

#: Small molecules: symbols and positions in Angstrom, from ideal bond lengths and angles.
_H, _R = 1.09, 1.39
MOLECULES = {
    "water": [("O", 0.0, 0.0, 0.0), ("H", 0.757, 0.586, 0.0), ("H", -0.757, 0.586, 0.0)],
    "ammonia": [("N", 0.0, 0.0, 0.116), ("H", 0.0, 0.94, -0.27), ("H", 0.814, -0.47, -0.27), ("H", -0.814, -0.47, -0.27)],
    "carbonyl": [("C", 0.0, 0.0, 0.0), ("O", 1.21, 0.0, 0.0), ("H", -0.59, 0.94, 0.0), ("H", -0.59, -0.94, 0.0)],
    "cyanide": [("H", -1.07, 0.0, 0.0), ("C", 0.0, 0.0, 0.0), ("N", 1.16, 0.0, 0.0)],
    "methanol": [("C", 0.0, 0.0, 0.0), ("O", 1.41, 0.0, 0.0), ("H", 1.72, 0.91, 0.0), ("H", -0.39, -1.02, 0.0), ("H", -0.39, 0.51, 0.88), ("H", -0.39, 0.51, -0.88)],
}


def order_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a structure and a line an atom: the flag is its element, the quantity its mass, and price, discount and
    tax its coordinates, all as decimals, so that sums are exact."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("struct_id"), F.lit(0).alias("atom_idx"), "l_returnflag", *LINE_ORDER)
    # Decimals follow once lines are numbered, so that no value moves twice.
    return renumbered(rows, *LINE_ORDER).select(
        "struct_id", "atom_idx", F.col("l_returnflag").alias("element"),
        F.col("l_quantity").cast("decimal(4,0)").alias("mass"), F.col("l_extendedprice").cast("decimal(9,2)").alias("x"),
        F.col("l_discount").cast("decimal(4,2)").alias("y"), F.col("l_tax").cast("decimal(4,2)").alias("z"),
    )


SQL_ATOMS = """
atoms AS (
  SELECT l_orderkey AS struct_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::INTEGER AS atom_idx,
         l_returnflag AS element, l_quantity::DECIMAL(4,0) AS mass, l_extendedprice::DECIMAL(9,2) AS x,
         l_discount::DECIMAL(4,2) AS y, l_tax::DECIMAL(4,2) AS z
  FROM lineitem)"""


def chain_bonds(atoms: DataFrame, same: bool = False) -> DataFrame:
    """Bonds between neighbouring lines of an order, both ways; same: between lines of one element alone."""
    a = atoms.select("struct_id", F.col("atom_idx").alias("i"), F.col("element").alias("e1"))
    b = atoms.select("struct_id", (F.col("atom_idx") - 1).alias("i"), F.col("element").alias("e2"))
    met = a.join(b, ["struct_id", "i"])
    met = met.where("e1 = e2") if same else met
    one = met.select("struct_id", "i", (F.col("i") + 1).alias("j"))
    return one.unionByName(one.select("struct_id", F.col("j").alias("i"), F.col("i").alias("j")))


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crystal of one atom for each supplier, in a box whose edges follow from its key: lattice, element, x, y, z."""
    s = F.col("s_suppkey")
    edge = lambda base, m: (base + s % m).cast("double")
    zero = F.lit(0.0)
    rows = ((edge(4, 7), zero, zero), (zero, edge(5, 5), zero), (zero, zero, edge(6, 3)))
    names = F.array(F.lit("C"), F.lit("N"), F.lit("O"), F.lit("Cl"))
    return table(spark, sf_dir, "supplier").select(
        s.alias("struct_id"), F.array(*(F.array(*r) for r in rows)).alias("lattice"), F.lit(0).alias("atom_idx"),
        F.get(names, (s % 4).cast("int")).alias("element"), *(((s % m / 4).cast("double") + 0.0137).alias(c) for c, m in zip("xyz", (5, 9, 11), strict=True)),
    )


SQL_CELLS = """
cells AS (
  SELECT s_suppkey AS struct_id, (4 + s_suppkey % 7)::DOUBLE AS a, (5 + s_suppkey % 5)::DOUBLE AS b, (6 + s_suppkey % 3)::DOUBLE AS c,
         (['C', 'N', 'O', 'Cl'])[s_suppkey % 4 + 1] AS element, ([1.7, 1.55, 1.5, 1.75])[s_suppkey % 4 + 1]::DOUBLE AS r,
         (s_suppkey % 5)::DOUBLE / 4 + 0.0137 AS x, (s_suppkey % 9)::DOUBLE / 4 + 0.0137 AS y, (s_suppkey % 11)::DOUBLE / 4 + 0.0137 AS z
  FROM supplier)"""


def supplier_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule for each supplier, one of MOLECULES by its key, turned and moved by its key: struct_id, kind, elements,
    geometry, lattice (empty)."""
    kinds = [(k, n, [a[0] for a in atoms], [list(map(float, a[1:])) for a in atoms]) for k, (n, atoms) in enumerate(MOLECULES.items())]
    lookup = spark.createDataFrame(kinds, "k int, kind string, elements array<string>, base array<array<double>>")
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s, (s % len(kinds)).cast("int").alias("k")).join(F.broadcast(lookup), "k")
    turn = G.euler_columns((s * 37 % 360).cast("double"), (s * 59 % 360).cast("double"), (s * 83 % 360).cast("double"))
    put = lambda p: F.array(*(v + (s % m) for v, m in zip(G.rotated([p[0], p[1], p[2]], turn), (3, 5, 7), strict=True)))
    return rows.select(
        F.format_string("s%08d", s).alias("struct_id"), "kind", "elements", F.transform("base", put).alias("geometry"),
        F.array().cast("array<array<double>>").alias("lattice"),
    )


def supplier_crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_molecules() in cubic cells of 6 to 8 Angstrom, each with a second molecule half a cell away."""
    rows = supplier_molecules(spark, sf_dir)
    edge = 6.0 + F.pmod(F.xxhash64("struct_id"), F.lit(3)).cast("double")
    zero = F.lit(0.0)
    lattice = F.array(F.array(edge, zero, zero), F.array(zero, edge, zero), F.array(zero, zero, edge))
    second = F.transform("geometry", lambda p: F.transform(p, lambda v: v + edge / 2))
    return rows.withColumns({"lattice": lattice, "geometry": F.concat("geometry", second), "elements": F.concat("elements", "elements")})
