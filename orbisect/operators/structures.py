"""Structures as rows and as atoms: validation, composition, moments, moves and parts.

`structures` has a row for each structure (struct_id, elements, geometry, lattice, properties); `atoms` has one for each
atom (struct_id, atom_idx, element, x, y, z). All operators take frames and return frames; none changes its input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import geometry as G

STRUCTURE_SCHEMA = (
    "struct_id string, elements array<string>, geometry array<array<double>>, lattice array<array<double>>, properties map<string,string>"
)
ATOM_COLUMNS = ("struct_id", "atom_idx", "element", "x", "y", "z")


def to_atoms(structures: DataFrame) -> DataFrame:
    """One row an atom, in order."""
    both = F.arrays_zip(F.col("elements").alias("e"), F.col("geometry").alias("g"))
    rows = structures.select("struct_id", F.posexplode(both).alias("atom_idx", "a"))
    return rows.select("struct_id", "atom_idx", F.col("a.e").alias("element"), *(F.col("a.g")[i].alias(n) for i, n in enumerate("xyz")))


def to_structures(atoms: DataFrame, lattices: DataFrame | None = None, properties: DataFrame | None = None) -> DataFrame:
    """Rows of arrays from atoms; lattices (struct_id, lattice) and properties (struct_id, properties) are met by id."""
    rows = F.array_sort(F.collect_list(F.struct("atom_idx", "element", F.array("x", "y", "z").alias("g"))))
    out = atoms.groupBy("struct_id").agg(rows.alias("r"))
    out = out.select("struct_id", F.transform("r", lambda a: a["element"]).alias("elements"), F.transform("r", lambda a: a["g"]).alias("geometry"))
    none = F.array().cast("array<array<double>>")
    out = out.join(lattices, "struct_id", "left") if lattices is not None else out.withColumn("lattice", none)
    out = out.withColumn("lattice", F.coalesce("lattice", none))
    empty = F.create_map().cast("map<string,string>")
    return out.join(properties, "struct_id", "left") if properties is not None else out.withColumn("properties", empty)


def valid(structures: DataFrame) -> DataFrame:
    """Structures whose elements and positions are as many, whose positions are triples, and whose lattice is 3 x 3 or
    empty."""
    square = (F.size("lattice") == 3) & F.forall("lattice", lambda v: F.size(v) == 3)
    none = F.coalesce(F.size("lattice"), F.lit(0)) <= 0
    return structures.where((F.size("elements") == F.size("geometry")) & F.forall("geometry", lambda p: F.size(p) == 3) & (none | square))


def is_molecule(lattice: str = "lattice") -> Column:
    return F.coalesce(F.size(lattice), F.lit(0)) <= 0


def described(structures: DataFrame) -> DataFrame:
    """struct_id and `label`, such as "id: Crystal C6H6"."""
    counted = F.transform(F.array_sort(F.array_distinct("elements")), lambda e: F.concat(e, F.size(F.filter("elements", lambda x: x == e)).cast("string")))
    kind = F.when(is_molecule(), F.lit("Molecule")).otherwise(F.lit("Crystal"))
    return structures.select("struct_id", F.concat(F.col("struct_id"), F.lit(": "), kind, F.lit(" "), F.array_join(counted, "")).alias("label"))


def content_id(structures: DataFrame) -> DataFrame:
    """structures with ids where they lack one: kind, formula and a hash of the content, so reruns agree."""
    body = F.substring(F.sha2(F.to_json(F.struct("elements", "geometry", "lattice")), 256), 1, 10)
    counted = F.transform(F.array_sort(F.array_distinct("elements")), lambda e: F.concat(e, F.size(F.filter("elements", lambda x: x == e)).cast("string")))
    kind = F.when(is_molecule(), F.lit("Molecule")).otherwise(F.lit("Structure"))
    made = F.concat_ws("_", kind, F.array_join(counted, ""), body)
    return structures.withColumn("struct_id", F.coalesce(F.nullif("struct_id", F.lit("")), made))


# Composition and moments


def formula_counts(atoms: DataFrame) -> DataFrame:
    """struct_id, element, n."""
    return atoms.groupBy("struct_id", "element").agg(F.count("*").alias("n"))


def formulas(atoms: DataFrame) -> DataFrame:
    """struct_id and `formula`: symbols in order, each with its count. It stands for the unordered map as a join key."""
    parts = F.array_sort(F.collect_list(F.struct("element", "n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["element"], p["n"].cast("string"))), "")
    return formula_counts(atoms).groupBy("struct_id").agg(text.alias("formula"))


def with_mass(atoms: DataFrame) -> DataFrame:
    return atoms if "mass" in atoms.columns else atoms.withColumn("mass", E.mass(F.col("element")))


def centres(atoms: DataFrame) -> DataFrame:
    """struct_id, mass, com_x, com_y, com_z: one aggregation, merged before it moves."""
    total = F.sum("mass").cast("double")  # decimals are summed exactly and divided as doubles
    sums = [(F.sum(F.col("mass") * F.col(c)).cast("double") / total).alias(f"com_{c}") for c in "xyz"]
    return with_mass(atoms).groupBy("struct_id").agg(total.alias("mass"), *sums)


def density(atoms: DataFrame, lattices: DataFrame) -> DataFrame:
    """struct_id, density in g/cm3; structures without a lattice have none."""
    cells = lattices.where(~is_molecule()).select("struct_id", G.volume(G.lattice_columns()).alias("volume"))
    masses = with_mass(atoms).groupBy("struct_id").agg(F.sum("mass").alias("mass"))
    return masses.join(cells, "struct_id").select("struct_id", (E.DENSITY_UNIT * F.col("mass") / F.abs("volume")).alias("density"))


def inertia(atoms: DataFrame) -> DataFrame:
    """struct_id and six entries of the inertia tensor, divided by the sum of m r2: one hash aggregation."""
    x, y, z, m = (F.col(c) for c in ("x", "y", "z", "mass"))
    total = F.sum(m * (x * x + y * y + z * z)).cast("double")
    parts = {"ixx": m * (y * y + z * z), "iyy": m * (x * x + z * z), "izz": m * (x * x + y * y), "ixy": -m * x * y, "ixz": -m * x * z, "iyz": -m * y * z}
    return with_mass(atoms).groupBy("struct_id").agg(*((F.sum(v).cast("double") / total).alias(k) for k, v in parts.items()))


def extents(atoms: DataFrame, radius: Column | None = None) -> DataFrame:
    """struct_id, bounds of each axis (wider by the radius), and `scale`, half of the largest extent."""
    r = F.lit(0.0) if radius is None else radius
    bounds = [f(F.col(c) + s * r).alias(f"{n}_{c}") for c in "xyz" for n, f, s in (("min", F.min, -1), ("max", F.max, 1))]
    out = atoms.groupBy("struct_id").agg(*bounds)
    return out.withColumn("scale", F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz")) / 2)


def first_by_formula(atoms: DataFrame, order: str = "struct_id") -> DataFrame:
    """formula, struct_id and n: the first structure of each formula and how many have it."""
    return formulas(atoms).groupBy("formula").agg(F.min(order).alias("struct_id"), F.count("*").alias("n"))


# Moves


def moved(atoms: DataFrame, position: Sequence[Column]) -> DataFrame:
    return atoms.withColumns(dict(zip("xyz", position, strict=True)))


def translated(atoms: DataFrame, by: Sequence[float | Column]) -> DataFrame:
    return moved(atoms, [F.col(c) + d for c, d in zip("xyz", by, strict=True)])


def rotated(atoms: DataFrame, rotation: Sequence[Sequence[float]]) -> DataFrame:
    return moved(atoms, G.rotated(G.columns(), rotation))


def rotated_lattice(structures: DataFrame, rotation: Sequence[Sequence[float]]) -> DataFrame:
    """Crystals turned as a whole: lattice rows and positions by one matrix."""
    turn = lambda v: F.array(*(v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in rotation))
    return structures.withColumns({c: F.transform(c, turn) for c in ("geometry", "lattice")})


def centred(atoms: DataFrame) -> DataFrame:
    """Atoms relative to their structure's centre of mass, in one window over the structure."""
    by = Window.partitionBy("struct_id")
    m = F.col("mass") if "mass" in atoms.columns else E.mass(F.col("element"))
    return moved(atoms, [F.col(c) - F.sum(m * F.col(c)).over(by) / F.sum(m).over(by) for c in "xyz"])


def boxed(atoms: DataFrame, vacuum: float = 40.0) -> DataFrame:
    """Atoms moved to positive coordinates, with the edges of the box that holds them and the vacuum."""
    by = Window.partitionBy("struct_id")
    low = {c: F.min(c).over(by) for c in "xyz"}
    out = atoms.withColumns({f"shift_{c}": -low[c] for c in "xyz"} | {f"box_{c}": F.max(c).over(by) - low[c] + vacuum for c in "xyz"})
    return moved(out, [F.col(c) + F.col(f"shift_{c}") for c in "xyz"])


def fractional(atoms: DataFrame, lattices: DataFrame, inside: bool = False) -> DataFrame:
    """atoms with fa, fb, fc."""
    f = G.to_fractional(G.columns(), G.lattice_columns(), inside, G.lattice_columns("reciprocal"))
    return atoms.join(G.with_reciprocal(lattices), "struct_id").withColumns(dict(zip(("fa", "fb", "fc"), f, strict=True))).drop("reciprocal")


def wrapped(atoms: DataFrame, lattices: DataFrame) -> DataFrame:
    """Atoms inside their cells."""
    out = fractional(atoms, lattices, inside=True)
    return moved(out, G.to_cartesian([F.col(c) for c in ("fa", "fb", "fc")], G.lattice_columns())).select(*atoms.columns)


def cells(structures: DataFrame) -> DataFrame:
    """struct_id, a, b, c, alpha, beta, gamma, volume of crystals."""
    lat = G.lattice_columns()
    named = dict(zip(("a", "b", "c", "alpha", "beta", "gamma"), [*G.lengths(lat), *G.angles(lat)], strict=True))
    return structures.where(~is_molecule()).select("struct_id", *(v.alias(k) for k, v in named.items()), G.volume(lat).alias("volume"))


# Parts and unions


def renumbered(atoms: DataFrame, *order: str) -> DataFrame:
    by = Window.partitionBy("struct_id").orderBy(*order)
    return atoms.withColumn("atom_idx", F.row_number().over(by) - 1)


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Atoms of both under each struct_id, those of `first` first; ids in one alone stay."""
    both = first.withColumn("__k", F.lit(0)).unionByName(second.withColumn("__k", F.lit(1)))
    return renumbered(both, "__k", "atom_idx").drop("__k")


def combined_bonds(first: DataFrame, second: DataFrame, first_atoms: DataFrame) -> DataFrame:
    """Bonds of combined(): those of `second` are moved up by the atoms before them."""
    n = first_atoms.groupBy("struct_id").agg(F.count("*").cast("int").alias("n"))
    up = second.join(n, "struct_id", "left").select("struct_id", *((F.col(c) + F.coalesce("n", F.lit(0))).alias(c) for c in "ij"))
    return first.select("struct_id", "i", "j").unionByName(up)


def subset(atoms: DataFrame, bonds: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms named by chosen (struct_id, atom_idx), numbered anew, and the bonds among them."""
    kept = atoms.join(chosen.select("struct_id", "atom_idx"), ["struct_id", "atom_idx"], "left_semi").withColumn("old", F.col("atom_idx"))
    kept = renumbered(kept, "old")
    ids = kept.select("struct_id", "old", "atom_idx")
    own = bonds.join(ids.select("struct_id", F.col("old").alias("i"), F.col("atom_idx").alias("ni")), ["struct_id", "i"])
    own = own.join(ids.select("struct_id", F.col("old").alias("j"), F.col("atom_idx").alias("nj")), ["struct_id", "j"])
    return kept.drop("old"), own.select("struct_id", F.col("ni").alias("i"), F.col("nj").alias("j"))


def upserted(old: DataFrame, new: DataFrame, key: str = "struct_id") -> DataFrame:
    """Rows of both by key; where both have one, the new one stands. An anti join and a union: no sort of either."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def last_wins(rows: DataFrame, order: Sequence[str], key: str = "struct_id") -> DataFrame:
    """One row a key: the last in order, as when a folder is read file by file into a dictionary."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


# Properties and documents


def with_property(structures: DataFrame, key: str, value: Column) -> DataFrame:
    old = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return structures.withColumn("properties", F.map_concat(old, F.create_map(F.lit(key), value.cast("string"))))


def without_property(structures: DataFrame, key: str) -> DataFrame:
    return structures.withColumn("properties", F.map_filter("properties", lambda k, _: k != key))


def property_table(structures: DataFrame, keys: Sequence[str], kind: str = "string") -> DataFrame:
    """struct_id and a column for each property, null where a structure lacks it."""
    return structures.select("struct_id", *(F.try_element_at("properties", F.lit(k)).cast(kind).alias(k) for k in keys))


def documents(structures: DataFrame) -> DataFrame:
    """struct_id and `doc`: JSON of the fields that files hold."""
    body = F.struct("struct_id", "geometry", "elements", "lattice", "properties")
    return structures.select("struct_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("doc"))


DOCUMENT = "struct_id string, elements array<string>, geometry array<array<double>>, lattice array<array<double>>, properties map<string,string>"


def from_documents(docs: DataFrame, column: str = "doc", fallback_id: Column | None = None) -> DataFrame:
    """Structures from JSON; unknown keys at the top join the properties, a missing id is taken from `fallback_id`."""
    parsed = docs.withColumn("__d", F.from_json(column, DOCUMENT)).withColumn("__m", F.from_json(column, "map<string,string>"))
    more = F.map_filter("__m", lambda k, _: ~k.isin("struct_id", "elements", "geometry", "lattice", "properties"))
    empty = F.create_map().cast("map<string,string>")
    props = F.map_concat(F.coalesce("__d.properties", empty), F.map_filter(more, lambda k, _: ~F.map_contains_key(F.coalesce("__d.properties", empty), k)))
    fallback = F.lit(None).cast("string") if fallback_id is None else fallback_id
    return parsed.select(
        F.coalesce("__d.struct_id", fallback).alias("struct_id"), "__d.elements", "__d.geometry",
        F.coalesce("__d.lattice", F.array().cast("array<array<double>>")).alias("lattice"), props.alias("properties"),
    )


# Columns of values


def shifted_energy(rows: DataFrame, energy: str, molecules: int = 4, least: float | None = None) -> DataFrame:
    """rows with `energy_shift`: what lies above the minimum, in units of 0.010364 a molecule. The minimum is one value,
    found by a partial aggregation and joined as a scalar."""
    low = F.lit(least) if least is not None else F.lit(rows.agg(F.min(energy)).first()[0])
    return rows.withColumn("energy_shift", (F.col(energy) - low) / (0.010364 * molecules))


def aligned_histogram(rows: DataFrame, series: str, value: str, bins: int = 10, density: bool = False) -> DataFrame:
    """series, bin, n (and share): counts in equal bins over [min(0, least), max(0, largest)] of all series; the last bin
    holds its upper edge."""
    low, high = rows.agg(F.least(F.lit(0.0), F.min(value)), F.greatest(F.lit(0.0), F.max(value))).first()
    low, high = low or 0.0, high or 0.0
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(value) - low) / width).cast("int"), F.lit(bins - 1))
    out = rows.where(F.col(value).isNotNull()).groupBy(series, place.alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return out
    return out.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(series)) * width))
