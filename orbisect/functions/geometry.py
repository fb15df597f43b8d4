"""Vectors, lattices and rotations as column expressions, so that they stay inside generated code.

A vector is a triple of columns; a lattice is three of them, its rows. Nothing here collects or groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]
Lattice = Sequence[Vector]


def columns(prefix: str = "", names: str = "xyz") -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def lattice_columns(column: str = "lattice") -> list[list[Column]]:
    """Rows of an array<array<double>> column; nulls where there is no lattice, as filters may be taken after."""
    return [[F.get(F.get(F.col(column), F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors; a cosine that rounding put beyond 1 counts as 1."""
    cosine = dot(a, b) / (norm(a) * norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def volume(lat: Lattice) -> Column:
    """Determinant of the lattice: negative for a left-handed one."""
    return dot(lat[0], cross(lat[1], lat[2]))


def lengths(lat: Lattice) -> list[Column]:
    return [norm(v) for v in lat]


def angles(lat: Lattice) -> list[Column]:
    """alpha, beta, gamma: between b and c, a and c, a and b."""
    return [angle(lat[1], lat[2]), angle(lat[0], lat[2]), angle(lat[0], lat[1])]


def reciprocal(lat: Lattice) -> list[list[Column]]:
    """Columns of the inverse: the dot product with row i gives fractional coordinate i."""
    v = volume(lat)
    return [[c / v for c in cross(lat[(i + 1) % 3], lat[(i + 2) % 3])] for i in range(3)]


def with_reciprocal(lattices, name: str = "reciprocal"):
    """struct_id, lattice and its reciprocal rows as arrays. Joined to atoms it is computed once a structure, and the long
    expressions don't end up in each atom's."""
    rows = F.array(*(F.array(*r) for r in reciprocal(lattice_columns())))
    return lattices.select("struct_id", "lattice", rows.alias(name))


def to_fractional(position: Vector, lat: Lattice, inside: bool = False, inverse: Lattice | None = None) -> list[Column]:
    """Fractional coordinates; inside: each wrapped into [0, 1); inverse: reciprocal(lat) where it is at hand."""
    f = [dot(position, r) for r in inverse or reciprocal(lat)]
    return [F.pmod(x, F.lit(1.0)) for x in f] if inside else f


def to_cartesian(fraction: Vector, lat: Lattice, inside: bool = False, slack: float = 1e-4) -> list[Column]:
    """Cartesian coordinates; inside: whole cells are cut off first, and what is below -slack goes up by one."""
    f = list(fraction)
    if inside:
        cut = [x - F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)) for x in f]
        f = [F.when(x < -slack, x + 1).otherwise(x) for x in cut]
    return [sum((f[i] * lat[i][j] for i in range(1, 3)), f[0] * lat[0][j]) for j in range(3)]


def from_parameters(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> list[list[Column]]:
    """Lattice rows from lengths and angles in degrees: a along x, b in the xy plane."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    zero = F.lit(0.0)
    y = (ca - cb * cg) / sg
    return [[a * 1.0, zero, zero], [b * cg, b * sg, zero], [c * cb, c * y, c * F.sqrt(F.greatest(zero, 1 - cb * cb - y * y))]]


def euler_matrix(a: float, b: float, c: float, degrees: bool = True) -> list[list[float]]:
    """Rotation by a about x, then b about y, then c about z, all about fixed axes."""
    a, b, c = (math.radians(v) if degrees else v for v in (a, b, c))
    ca, sa, cb, sb, cc, sc = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(c), math.sin(c)
    return [
        [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa],
        [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa],
        [-sb, cb * sa, cb * ca],
    ]


def euler_columns(a: Column, b: Column, c: Column) -> list[list[Column]]:
    """euler_matrix of columns in degrees."""
    a, b, c = F.radians(a), F.radians(b), F.radians(c)
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return [
        [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa],
        [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa],
        [-sb, cb * sa, cb * ca],
    ]


def rotated(v: Vector, rotation) -> list[Column]:
    """rotation applied to v; entries are numbers or columns."""
    return [v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in rotation]
