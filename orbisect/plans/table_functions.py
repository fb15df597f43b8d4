"""Operators as SQL table functions: SELECT * FROM supercell(TABLE(structures), 2, 1, 1).

Functions of one structure take a table's rows as they come; functions of atoms take them PARTITION BY struct_id, which
deals a structure's atoms to one task and is asked for where a query leaves it out. Results have the columns that the
DataFrame calls have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import SkipRestOfInputTableException
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from ..session import reachable

KINDS = {"int": IntegerType(), "double": DoubleType(), "string": StringType()}
ATOMS = "atom_idx int, element string, x double, y double, z double"


def columns(table: AnalyzeArgument, *names: str) -> dict[str, DataType]:
    """The types of a table argument's columns; an error that names those it lacks."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    known = {f.name: f.dataType for f in table.dataType.fields}
    if lacking := [n for n in names if n not in known]:
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    return known


def constant(arg: AnalyzeArgument, what: str, least: float) -> float:
    if arg.isTable or arg.value is None or arg.value < least:
        raise ValueError(f"{what} is a constant of {least} or more")
    return arg.value


def schema(struct_id: DataType, rest: str) -> StructType:
    """struct_id and the columns that rest lists, of KINDS; no session is at hand here to read types with."""
    out = StructType().add("struct_id", struct_id)
    for name, kind in (x.split() for x in rest.split(", ")):
        out = out.add(name, KINDS[kind])
    return out


class Supercell:
    """The atoms of a crystal repeated a, b and c times along its edges, numbered anew from the cell itself outwards; rows without
    a lattice or atoms give none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, a: AnalyzeArgument, b: AnalyzeArgument, c: AnalyzeArgument) -> AnalyzeResult:
        known = columns(table, "struct_id", "elements", "geometry", "lattice")
        for n, arg in zip("abc", (a, b, c), strict=True):
            constant(arg, n, 1)
        return AnalyzeResult(schema(known["struct_id"], f"{ATOMS}, src_atom_idx int, na int, nb int, nc int"), select=[SelectedColumn(n) for n in ("struct_id", "elements", "geometry", "lattice")])

    def eval(self, row: Row, a: int, b: int, c: int) -> Iterator[tuple]:
        lattice = row["lattice"] or []
        if len(lattice) != 3 or row["elements"] is None or row["geometry"] is None:
            return
        k = 0
        for cell in sorted(product(range(a), range(b), range(c)), key=lambda n: (sum(n), n)):
            shift = [sum(n * v[d] for n, v in zip(cell, lattice, strict=True)) for d in range(3)]
            for i, (element, p) in enumerate(zip(row["elements"], row["geometry"], strict=True)):
                yield row["struct_id"], k, element, *(float(x + s) for x, s in zip(p, shift, strict=True)), i, *cell
                k += 1


class PairsWithin:
    """Pairs i < j of a structure's atoms no farther apart than a distance, in order."""

    @staticmethod
    def analyze(table: AnalyzeArgument, cutoff: AnalyzeArgument) -> AnalyzeResult:
        known = columns(table, "struct_id", "atom_idx", "x", "y", "z")
        constant(cutoff, "the distance", 0)
        return AnalyzeResult(
            schema(known["struct_id"], "i int, j int, d double"), partitionBy=[PartitioningColumn("struct_id")], orderBy=[OrderingColumn("atom_idx")],
            select=[SelectedColumn(n) for n in ("struct_id", "atom_idx", "x", "y", "z")],
        )

    def __init__(self):
        self.cells: dict[tuple, list[tuple]] = {}

    def eval(self, row: Row, cutoff: float) -> Iterator[tuple]:
        """Each atom meets those before it in its own and neighbouring cells, as wide as the distance."""
        p, width = (float(row["x"]), float(row["y"]), float(row["z"])), float(cutoff) or 1.0
        cell = tuple(int(v // width) for v in p)
        found = []
        for step in product((-1, 0, 1), repeat=3):
            for i, q in self.cells.get(tuple(c + s for c, s in zip(cell, step, strict=True)), ()):
                d = sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) ** 0.5
                if d <= cutoff:
                    found.append((row["struct_id"], i, row["atom_idx"], d))
        self.cells.setdefault(cell, []).append((row["atom_idx"], p))
        yield from sorted(found, key=lambda r: r[1])


class FirstAtoms:
    """The first n atoms of each structure; the rest of a structure isn't read."""

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        known = columns(table, "struct_id", "atom_idx", "element", "x", "y", "z")
        constant(n, "n", 0)
        return AnalyzeResult(schema(known["struct_id"], ATOMS), partitionBy=[PartitioningColumn("struct_id")], orderBy=[OrderingColumn("atom_idx")])

    def __init__(self):
        self.n = 0

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        if self.n >= n:
            raise SkipRestOfInputTableException("enough")
        self.n += 1
        yield row["struct_id"], row["atom_idx"], row["element"], float(row["x"]), float(row["y"]), float(row["z"])


FUNCTIONS = {"supercell": Supercell, "pairs_within": PairsWithin, "first_atoms": FirstAtoms}


def register(spark: SparkSession) -> None:
    """Name the functions in a session."""
    from pyspark.sql.functions import udtf

    reachable(spark)
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
