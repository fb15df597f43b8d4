"""Lattices of crystals compared whatever cell they are written in: reduction, primitive cells, measures, and a band join.

All of it is column expressions over one row a structure. A cell is reduced until no two of its edges and their negative
sum meet at an acute angle; the shortest three independent vectors of a lattice are then among seven known ones. Those
lengths, the same of the reciprocal lattice, and the volume depend on the lattice alone, not on how its cell is chosen.

If a linear map takes one lattice to another and changes no length by more than a factor f, it changes none of these
measures by more: k independent vectors stay k independent ones, so the k-th shortest is at most f times as long, and by
the inverse map at least 1/f times; the inverse transpose, which maps the reciprocal lattice, has the same bounds. So two
such crystals lie in the same or in neighbouring bands of log f in every measure, and a join over bands misses none.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workspace, written
from .structures import is_molecule

#: Steps of reduction in one pass over the rows; cells that need more get further passes.
STEPS = 60
PAIRS = tuple(combinations(range(4), 2))
VECTOR = "array<array<double>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, not anew wherever it stands and for each element of what goes over it."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def plus(a: Column, b: Column) -> Column:
    return F.array(*(a[k] + b[k] for k in range(3)))


def times(a: Column, by: Column | float) -> Column:
    return F.array(*(a[k] * by for k in range(3)))


def combined(weights: Column, rows: Column) -> Column:
    """weights (three) times the rows of a lattice."""
    return F.array(*(weights[0] * rows[0][k] + weights[1] * rows[1][k] + weights[2] * rows[2][k] for k in range(3)))


def superbase(lattice: Column) -> Column:
    """The three edges and the vector that takes their sum back to zero."""
    return F.concat(lattice, F.array(times(plus(plus(lattice[0], lattice[1]), lattice[2]), -1.0)))


def most_acute(s: Column) -> Column:
    """The largest product of two of the four vectors, and which they are."""
    return F.array_max(F.array(*(F.struct(dot(s[i], s[j]).alias("d"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in PAIRS)))


def is_reduced(s: Column) -> Column:
    return most_acute(s)["d"] <= 1e-11 * (dot(s[0], s[0]) + dot(s[1], s[1]) + dot(s[2], s[2]) + dot(s[3], s[3]))


def reduced(s: Column, steps: int = STEPS) -> Column:
    """A superbase after up to `steps` steps, each of which turns one of the two vectors with the largest product round and adds
    it to the other two; the sum of squares falls until no product is above zero."""

    def step(s: Column, _: Column) -> Column:
        def turned(p: Column) -> Column:
            turn = F.get(s, p["i"])
            kept = lambda k: F.when(p["i"] == k, times(turn, -1.0)).when(p["j"] == k, s[k]).otherwise(plus(s[k], turn))
            return F.when(is_reduced(s), s).otherwise(F.array(*(kept(k) for k in range(4))))

        return bound(most_acute(s), turned)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), s, step)


def independent(vectors: Column) -> Column:
    """The three shortest independent ones of vectors that are given as sorted structs (l, v): l is the squared length."""
    apart = lambda a, x: bound(cross(a["v"], x["v"]), lambda c: dot(c, c)) > 1e-8 * a["l"] * x["l"]
    first = vectors[0]
    second = F.filter(vectors, lambda x: apart(first, x))[0]

    def third(b: Column) -> Column:
        det = lambda x: F.abs(dot(cross(first["v"], b["v"]), x["v"]))
        return F.array(first, b, F.filter(vectors, lambda x: det(x) > 1e-4 * F.sqrt(first["l"] * b["l"] * x["l"]))[0])

    return bound(second, third)


def shortest(s: Column) -> Column:
    """The shortest independent vectors of the lattice of a reduced superbase."""
    seven = [s[0], s[1], s[2], s[3], plus(s[0], s[1]), plus(s[0], s[2]), plus(s[0], s[3])]
    listed = F.array_sort(F.array(*(F.struct(dot(v, v).alias("l"), v.alias("v")) for v in seven)))
    return bound(listed, independent)


def reciprocal(rows: Column) -> Column:
    """Rows of the inverse's transpose."""
    volume = dot(rows[0], cross(rows[1], rows[2]))
    return bound(volume, lambda v: F.array(*(times(cross(rows[(k + 1) % 3], rows[(k + 2) % 3]), 1 / v) for k in range(3))))


def fraction(p: Column, inverse: Column) -> Column:
    return F.array(*(dot(p, inverse[k]) for k in range(3)))


def nearest_zero(f: Column) -> Column:
    return F.transform(f, lambda x: x - F.round(x))


def with_reduced(rows: DataFrame, column: str, folder: str, name: str) -> DataFrame:
    """rows, written, with the superbase `column` reduced in as many passes as its worst cell needs."""
    less, done = reduced(F.col(column)), is_reduced(F.col(column))  # built once: they are long
    for k in range(1000):
        rows = written(rows.withColumn(column, less), folder, f"{name}-{k}")
        if rows.where(~done).isEmpty():
            return rows
    raise RuntimeError("a lattice has no reduced cell")


def primitive(structures: DataFrame, folder: str, tolerance: float = 0.3) -> DataFrame:
    """Crystals (struct_id, elements, geometry, lattice, more columns) with n_cells, how often their cell holds a primitive one,
    and `basis`, the three shortest independent vectors of the lattice with all translations that leave the structure as it
    is: each atom meets one of its element within tolerance.

    Candidates take the first atom of the rarest element to each other one, so most are given up at once. A translation of
    a cell with n of them has order n at most, by which it is made exact. Structures without a lattice, whose cell has no
    volume, or without atoms are left out.
    """
    rows = structures.where(~is_molecule() & (F.size("elements") > 0) & (F.size("elements") == F.size("geometry")))
    rows = rows.where(F.abs(dot(F.col("lattice")[0], cross(F.col("lattice")[1], F.col("lattice")[2]))) > 1e-6)
    rows = with_reduced(rows.withColumn("s", superbase(F.col("lattice"))), "s", folder, "cells")
    rows = rows.withColumn("cell", F.transform(shortest(F.col("s")), lambda x: x["v"])).withColumn("inverse", reciprocal(F.col("cell")))
    rows = rows.withColumn("f", F.transform("geometry", lambda p: fraction(p, F.col("inverse"))))
    counted = F.transform(F.array_distinct("elements"), lambda e: F.struct(F.size(F.filter("elements", lambda x: x == e)).alias("n"), e.alias("e")))
    rows = rows.withColumn("atoms", F.arrays_zip(F.col("elements").alias("e"), F.col("f").alias("f"))).withColumn("rare", F.array_min(counted)["e"])
    own = F.transform(F.filter("atoms", lambda a: a["e"] == F.col("rare")), lambda a: a["f"])
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    rows = rows.withColumn("own", own)
    candidates = F.transform(F.slice("own", 2, F.size("own")), lambda f: nearest_zero(minus(f, F.col("own")[0])))

    def close(d: Column) -> Column:
        return bound(combined(nearest_zero(d), F.col("cell")), lambda v: dot(v, v)) <= tolerance * tolerance

    def keeps(t: Column) -> Column:
        return F.forall("atoms", lambda a: F.exists("atoms", lambda b: (a["e"] == b["e"]) & close(minus(F.zip_with(a["f"], t, lambda x, y: x + y), b["f"]))))

    rows = rows.withColumn("found", F.filter(candidates, keeps))
    # Exact: n times a translation is a vector of the cell.
    order = F.size("found") + 1
    rows = rows.withColumn("found", F.array_distinct(F.transform("found", lambda t: F.transform(t, lambda x: F.round(x * order) / order))))
    zero = F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    shifts = F.expr(f"array({', '.join(f'array({a}D, {b}D, {c}D)' for a, b, c in product((-2, -1, 0, 1, 2), repeat=3))})")
    every = F.flatten(F.transform(F.concat(zero, F.col("found")), lambda t: F.transform(shifts, lambda n: combined(F.zip_with(t, n, lambda x, y: x + y), F.col("cell")))))
    listed = F.array_sort(F.filter(F.transform(every, lambda v: F.struct(dot(v, v).alias("l"), v.alias("v"))), lambda x: x["l"] > 1e-6))
    basis = F.when(F.size("found") == 0, F.col("cell")).otherwise(F.transform(bound(listed, independent), lambda x: x["v"]))
    return rows.withColumn("basis", basis).withColumn("n_cells", order).select(*structures.columns, "basis", "n_cells")


def measured(structures: DataFrame, folder: str | None = None, tolerance: float = 0.3, scaled: bool = False) -> DataFrame:
    """struct_id, formula (that of the least unit), n_atoms (of a primitive cell) and `measures`: the lengths of the three
    shortest independent lattice vectors, the spacings that go with the reciprocal ones, and the cube root of the volume;
    scaled: in units of the cube root of the volume of an atom."""
    folder = folder or workspace(structures.sparkSession, "lattices")
    some = [c for c in ("is_new",) if c in structures.columns]
    rows = primitive(structures.select("struct_id", "elements", "geometry", "lattice", *some), folder, tolerance)
    rows = written(rows.drop("geometry", "lattice"), folder, "primitive")
    rows = rows.withColumn("edges", F.transform("basis", lambda v: F.sqrt(dot(v, v)))).withColumn("volume", F.abs(dot(F.col("basis")[0], cross(F.col("basis")[1], F.col("basis")[2]))))
    counts = F.transform(F.array_sort(F.array_distinct("elements")), lambda e: F.struct(e.alias("e"), F.size(F.filter("elements", lambda x: x == e)).alias("n")))
    rows = rows.withColumn("counts", counts)
    common = F.aggregate("counts", F.lit(0), lambda a, x: greatest_divisor(a, x["n"]))
    rows = rows.withColumn("common", common)
    formula = F.array_join(F.transform("counts", lambda x: F.concat(x["e"], (x["n"] / F.col("common")).cast("int").cast("string"))), " ")
    rows = rows.select("struct_id", *some, formula.alias("formula"), (F.size("elements") / F.col("n_cells")).cast("int").alias("n_atoms"), "edges", "volume", superbase(reciprocal(F.col("basis"))).alias("s"))
    rows = with_reduced(rows, "s", folder, "reciprocal")
    spacings = F.transform(shortest(F.col("s")), lambda x: 1 / F.sqrt(x["l"]))
    unit = F.pow(F.col("volume") / F.col("n_atoms"), 1 / 3) if scaled else F.lit(1.0)
    every = F.concat("edges", spacings, F.array(F.pow("volume", F.lit(1 / 3))))
    return rows.select("struct_id", *some, "formula", "n_atoms", F.transform(every, lambda x: x / unit).alias("measures"))


def greatest_divisor(a: Column, b: Column) -> Column:
    """Of two counts, the first of which may be 0."""
    small, large = F.least(a, b), F.greatest(a, b)
    shared = F.filter(F.sequence(F.lit(1), F.greatest(small, F.lit(1))), lambda d: (small % d == 0) & (large % d == 0))
    return F.when(small == 0, large).otherwise(F.array_max(shared))


def alike(rows: DataFrame, strain: float) -> DataFrame:
    """id1, id2, value of measured() rows of one formula and as many atoms whose measures differ by a factor of at most
    1 + strain each; value: the largest factor less 1. Exact: bands of that width are met with their neighbours, and where
    rows say which of them is_new, one of a pair is."""
    some = [c for c in ("is_new",) if c in rows.columns]
    width = math.log1p(strain) * (1 + 1e-9)
    band = lambda k: F.floor(F.log(F.col("measures")[k]) / width)
    rows = rows.withColumns({f"b{k}": band(k) for k in range(3)})
    around = F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in product((-1, 0, 1), repeat=3)))
    keys = ["formula", "n_atoms", "b0", "b1", "b2"]
    a = rows.select("formula", "n_atoms", *(F.col(c).alias(f"{c}1") for c in ("measures", *some)), F.col("struct_id").alias("id1"), "b0", "b1", "b2", F.explode(around).alias("d"))
    a = a.withColumns({f"b{k}": F.col(f"b{k}") + F.col(f"d.d{k}") for k in range(3)}).drop("d")
    b = rows.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("measures", *some)), F.col("struct_id").alias("id2"))
    met = a.join(b, keys).where("id1 < id2")
    met = met.where("is_new1 OR is_new2") if some else met
    off = F.array_max(F.zip_with("measures1", "measures2", lambda x, y: F.greatest(x / y, y / x)))
    return met.withColumn("value", off - 1).where(F.col("value") <= strain).select("id1", "id2", "value")
