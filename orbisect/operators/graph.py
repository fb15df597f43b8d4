"""Molecular graphs: molecules as components, neighbourhoods, fragments, descriptors, angles, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import geometry as G
from ..session import workspace, written
from .components import connected
from .pairs import within
from .structures import formulas


def packed(atoms: DataFrame, bonds: DataFrame, repeats: bool = False) -> DataFrame:
    """struct_id and `a`, its atoms in order: atom_idx, near (their bonded atoms in order, each once, or as often as bonds say)
    and r (their row). Where atoms aren't numbered from 0, atom_idx and near are their places instead. Atoms and bonds are
    dealt once, by struct_id, which serves both aggregations."""
    gathered = F.collect_list("j") if repeats else F.collect_set("j")
    rows = atoms.select("struct_id", "atom_idx", F.struct("*").alias("r"), F.lit(None).cast("int").alias("j"))
    links = bonds.select("struct_id", F.col("i").cast("int").alias("atom_idx"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.col("j").cast("int").alias("j"))
    dealt = rows.unionByName(links).repartition("struct_id")
    each = dealt.groupBy("struct_id", "atom_idx").agg(F.first("r", ignorenulls=True).alias("r"), F.array_sort(gathered).alias("near")).where("r IS NOT NULL")
    listed = F.sort_array(F.collect_list(F.struct("atom_idx", "near", "r"))) if orderable(rows) else F.array_sort(F.collect_list(F.struct("atom_idx", "near", "r")), lambda x, y: F.when(x["atom_idx"] < y["atom_idx"], -1).when(x["atom_idx"] > y["atom_idx"], 1).otherwise(0))
    out = each.groupBy("struct_id").agg(listed.alias("a"))
    dense = (F.col("a")[0]["atom_idx"] == 0) & (F.element_at("a", -1)["atom_idx"] == F.size("a") - 1)
    place = lambda j: (F.array_position("a.atom_idx", j) - 1).cast("int")
    placed = F.transform("a", lambda x, k: F.struct(k.alias("atom_idx"), F.transform(x["near"], place).alias("near"), x["r"].alias("r")))
    return out.withColumn("a", F.when(dense, F.col("a")).otherwise(placed))


def orderable(rows: DataFrame) -> bool:
    return "map<" not in rows.schema["r"].dataType.simpleString() and "variant" not in rows.schema["r"].dataType.simpleString()


def unpacked(rows: DataFrame, columns: list[str], **values: Column) -> DataFrame:
    """The atoms of packed() rows again, with a column for each array of values that has one for each atom."""
    names = [c for c in columns if c not in values]
    both = rows.select(F.explode(F.arrays_zip(F.col("a.r").alias("r"), *(v.alias(k) for k, v in values.items()))).alias("x"))
    return both.select(*(F.col("x.r").getField(c).alias(c) for c in names), *(F.col(f"x.{k}").alias(k) for k in values))


#: Atoms of a structure that one row works through; larger ones go in rounds over links.
ROW = 100_000


def molecules(atoms: DataFrame, bonds: DataFrame, folder: str | None = None, most: int = ROW) -> DataFrame:
    """struct_id, atom_idx, mol_idx: components over bonds, numbered by their least atom.

    Bonds never leave a structure, so one of up to `most` atoms, numbered from 0, is a row: each atom takes the least
    label of it and its neighbours, then that label's own, until nothing changes. Others, of any size, go in rounds of
    stars over all links. Bonds may come from one end or both.
    """
    folder = folder or workspace(atoms.sparkSession, "molecules")
    every = atoms.select("struct_id", "atom_idx")
    sizes = every.groupBy("struct_id").agg(F.count("*").alias("n"), F.min("atom_idx").alias("low"), F.max("atom_idx").alias("high"))
    odd = written(sizes.where((F.col("n") > most) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)).select("struct_id"), folder, "odd")
    both = bonds.select("struct_id", "i", "j").unionByName(bonds.select("struct_id", F.col("j").alias("i"), F.col("i").alias("j")))
    some = not odd.isEmpty()
    own = [x.join(odd, "struct_id", "left_anti") if some else x for x in (every, both)]

    def turn(s: Column, _: Column) -> Column:
        least = lambda p: F.transform("a", lambda x: F.least(F.get(p, x["atom_idx"]), F.coalesce(F.array_min(F.transform(x["near"], lambda j: F.get(p, j))), F.get(p, x["atom_idx"]))))
        jump = lambda p: F.transform(p, lambda x: F.get(p, x))
        bound = lambda v, use: F.transform(F.array(v), use)[0]
        settled = lambda p: F.struct(p.alias("p"), (p == s["p"]).alias("stable"))
        return F.when(s["stable"], s).otherwise(bound(bound(least(s["p"]), jump), settled))

    rows = packed(*own)
    roots = F.aggregate(F.sequence(F.lit(0), F.size("a")), F.struct(F.transform("a", lambda x: x["atom_idx"]).alias("p"), F.lit(False).alias("stable")), turn)["p"]
    rows = rows.withColumn("p", roots).withColumn("heads", F.array_sort(F.array_distinct("p")))
    out = unpacked(rows, ["struct_id", "atom_idx"], mol_idx=F.transform("p", lambda r: (F.array_position("heads", r) - 1).cast("int")))
    if not some:
        return out
    node = lambda i: F.struct("struct_id", F.col(i).alias("atom_idx"))
    links = bonds.join(odd, "struct_id", "left_semi")
    found = connected(links.select(node("i").alias("a"), node("j").alias("b")), folder)
    of = found.select("node.struct_id", "node.atom_idx", F.col("root.atom_idx").alias("root"))
    named = every.join(odd, "struct_id", "left_semi").join(of, ["struct_id", "atom_idx"], "left").withColumn("root", F.coalesce("root", "atom_idx"))
    number = F.dense_rank().over(Window.partitionBy("struct_id").orderBy("root")) - 1
    return out.unionByName(named.select("struct_id", "atom_idx", number.alias("mol_idx")))


def neighbourhoods(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """atoms with `neighbourhood`: the atom's symbol, then its bonded atoms' in order."""
    symbols = atoms.select("struct_id", F.col("atom_idx").alias("j"), F.col("element").alias("e"))
    near = bonds.select("struct_id", "i", "j").join(symbols, ["struct_id", "j"]).groupBy("struct_id", F.col("i").alias("atom_idx"))
    listed = near.agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("n"))
    out = atoms.join(listed, ["struct_id", "atom_idx"], "left")
    return out.withColumn("neighbourhood", F.concat("element", F.coalesce("n", F.lit("")))).drop("n")


def fragments(named: DataFrame) -> DataFrame:
    """struct_id, neighbourhood, n."""
    return named.groupBy("struct_id", "neighbourhood").agg(F.count("*").alias("n"))


def fragment_signature(named: DataFrame) -> DataFrame:
    """struct_id and `signature`, its fragments with their counts in order: equal for equal bonding."""
    parts = F.array_sort(F.collect_list(F.struct("neighbourhood", "n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["neighbourhood"], p["n"].cast("string"))), ",")
    return fragments(named).groupBy("struct_id").agg(text.alias("signature"))


def descriptors(named: DataFrame, bonds: DataFrame, shells: int = 4) -> DataFrame:
    """named with `descriptor`: neighbourhoods of the atom, of its bonded atoms, of those two bonds away, and so on, each
    shell in order. Shells beyond the molecule are empty. A structure is one row, in which each atom's shells grow, so one
    shuffle serves any number of them."""

    def shell(s: Column, _: Column) -> Column:
        reached = F.array_except(F.array_distinct(F.flatten(F.transform(s["front"], lambda j: F.get("a", j)["near"]))), s["seen"])
        said = lambda f: F.array_join(F.array_sort(F.transform(f, lambda j: F.get("a", j)["r"]["neighbourhood"])), "")
        grown = lambda f: F.struct(f.alias("front"), F.concat(s["seen"], f).alias("seen"), F.when(F.size(f) > 0, F.concat(s["w"], F.array(said(f)))).otherwise(s["w"]).alias("w"))
        return F.transform(F.array(reached), grown)[0]

    def told(x: Column) -> Column:
        own = F.array(x["atom_idx"])
        start = F.struct(own.alias("front"), own.alias("seen"), F.array(x["r"]["neighbourhood"]).alias("w"))
        return F.array_join(F.aggregate(F.sequence(F.lit(1), F.lit(shells - 1)), start, shell)["w"], "|") if shells > 1 else x["r"]["neighbourhood"]

    return unpacked(packed(named, bonds), named.columns, descriptor=F.transform("a", told))


def refined(atoms: DataFrame, bonds: DataFrame, start: str = "element") -> DataFrame:
    """atoms with `descriptor`: equal for atoms that no chain of bonds tells apart, whatever the diameter of their structure.

    Each atom's colour, at first its `start`, is hashed with its neighbours' colours in order, again and again until a
    structure has no more colours than before. Structures become one row each, so one shuffle serves all rounds, and each
    stops on its own. The last hash is kept: it says how many neighbours of each colour an atom has, so atoms of two
    structures have equal descriptors only if all further rounds would agree. Bonds (struct_id, i, j) come from both ends,
    and repeated ones count once.
    """
    rows = packed(atoms, bonds)
    first = F.transform("a", lambda a: F.md5(F.coalesce(a["r"][start].cast("string"), F.lit(""))))
    state = lambda c, stable: F.struct(c.alias("c"), F.size(F.array_distinct(c)).alias("k"), stable.alias("stable"))

    def turn(s: Column, _: Column) -> Column:
        told = lambda a: F.md5(F.concat_ws("|", F.get(s["c"], a["atom_idx"]), F.array_join(F.array_sort(F.transform(a["near"], lambda j: F.get(s["c"], j))), ",")))
        settled = lambda c: state(c, F.size(F.array_distinct(c)) == s["k"])
        return F.when(s["stable"], s).otherwise(F.transform(F.array(F.transform("a", told)), settled)[0])

    last = F.aggregate(F.sequence(F.lit(0), F.size("a")), state(first, F.lit(False)), turn)["c"]
    return unpacked(rows, atoms.columns, descriptor=last)


def graph_signature(described: DataFrame) -> DataFrame:
    """struct_id and `signature`: equal for structures whose atoms have equal descriptors."""
    listed = F.array_join(F.array_sort(F.collect_list("descriptor")), ";")
    return described.groupBy("struct_id").agg(F.sha2(listed, 256).alias("signature"))


def ordered_by_descriptor(described: DataFrame) -> DataFrame:
    """described with `place`: atoms in an order that depends on their descriptors, ties by atom_idx."""
    w = Window.partitionBy("struct_id").orderBy(F.xxhash64("descriptor"), "descriptor", "atom_idx")
    return described.withColumn("place", F.row_number().over(w) - 1)


def matched_atoms(first: DataFrame, second: DataFrame) -> DataFrame:
    """Atoms of two structures met by equal descriptors: the k-th of a descriptor with the k-th. Columns pair_id, i, j."""
    rank = F.row_number().over(Window.partitionBy("pair_id", "descriptor").orderBy("atom_idx"))
    side = lambda df, n: df.select("pair_id", "descriptor", F.col("atom_idx").alias(n), rank.alias("k"))
    return side(first, "i").join(side(second, "j"), ["pair_id", "descriptor", "k"]).select("pair_id", "i", "j")


def bond_angles(atoms: DataFrame, bonds: DataFrame, unique: bool = True) -> DataFrame:
    """struct_id, i, centre, j, angle: i < j bound to one centre; unique: of angles over the same three atoms, as in a ring of
    three, the one with the least centre."""
    place = lambda k: atoms.select("struct_id", F.col("atom_idx").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("x", "y", "z", "element")))
    a = bonds.select("struct_id", F.col("i").alias("centre"), F.col("j").alias("i"))
    b = bonds.select("struct_id", F.col("i").alias("centre"), "j")
    met = a.join(b, ["struct_id", "centre"]).where("i < j")
    for k in ("centre", "i", "j"):
        met = met.join(place(k), ["struct_id", k])
    arm = lambda k: [F.col(f"{c}_{k}") - F.col(f"{c}_centre") for c in "xyz"]
    out = met.select("struct_id", "i", "centre", "j", F.concat("element_i", "element_centre", "element_j").alias("kind"), G.angle(arm("i"), arm("j")).alias("angle"))
    if not unique:
        return out
    w = Window.partitionBy("struct_id", F.array_sort(F.array("i", "centre", "j"))).orderBy("centre")
    return out.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def molecule_structures(atoms: DataFrame, mols: DataFrame) -> DataFrame:
    """Atoms under ids of their own molecule, struct_id_mol_idx, numbered anew."""
    rows = atoms.join(mols, ["struct_id", "atom_idx"])
    n = F.row_number().over(Window.partitionBy("struct_id", "mol_idx").orderBy("atom_idx")) - 1
    named = rows.withColumn("__n", n).withColumn("struct_id", F.concat_ws("_", "struct_id", F.lit("molecule"), "mol_idx"))
    return named.withColumn("atom_idx", F.col("__n")).drop("__n", "mol_idx")


def component_counts(mols: DataFrame) -> DataFrame:
    return mols.groupBy("struct_id").agg(F.countDistinct("mol_idx").alias("n_molecules"))


def is_dimer(n_molecules: str = "n_molecules", lattice: str = "lattice") -> Column:
    return (F.col(n_molecules) == 2) & (F.coalesce(F.size(lattice), F.lit(0)) <= 0)


def bonding_signatures(atoms: DataFrame, mults: list[float]) -> DataFrame:
    """formula, mult, struct_id, signature for each bond multiplier: what dedup.unique_by_bonding() chooses among.

    Distances are found once, for the largest multiplier; smaller ones filter the same pairs.
    """
    rows = atoms.withColumn("r", E.covalent(F.col("element")))
    largest = max(mults) * 2 * max(E.COVALENT.values())
    near = within(rows, max(mults) * (F.col("r1") + F.col("r2")), largest, keep=("r", "element"), ordered=True)
    each = F.explode(F.array(*(F.lit(float(m)) for m in mults))).alias("mult")
    bonded = near.select("struct_id", "i", "d", "r1", "r2", "element2", each).where(F.col("d") <= F.col("mult") * (F.col("r1") + F.col("r2")))
    listed = bonded.groupBy("struct_id", "mult", F.col("i").alias("atom_idx")).agg(F.array_join(F.array_sort(F.collect_list("element2")), "").alias("n"))
    every = atoms.select("struct_id", "atom_idx", "element", each).join(listed, ["struct_id", "mult", "atom_idx"], "left")
    named = every.select("struct_id", "mult", F.concat("element", F.coalesce("n", F.lit(""))).alias("neighbourhood"))
    parts = named.groupBy("struct_id", "mult", "neighbourhood").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("neighbourhood", "n"))), lambda p: F.concat_ws(":", p["neighbourhood"], p["n"].cast("string"))), ",")
    return parts.groupBy("struct_id", "mult").agg(text.alias("signature")).join(formulas(atoms), "struct_id").select("formula", "mult", "struct_id", "signature")


def neighbours_by_element(neighbours: DataFrame) -> DataFrame:
    """struct_id, i and `near`: for each element, the neighbours of that element in order of distance. A map rather than a
    column an element, so that the elements needn't be known before."""
    lists = neighbours.groupBy("struct_id", "i", "element2").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("l"))
    return lists.groupBy("struct_id", "i").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element2", F.transform("l", lambda x: x["j"]))))).alias("near"))


def interactions(neighbours: DataFrame, mols: DataFrame) -> DataFrame:
    """Neighbours (struct_id, i, j, d, ...) whose atoms are in different molecules."""
    of = lambda n, k: mols.select("struct_id", F.col("atom_idx").alias(k), F.col("mol_idx").alias(f"mol_idx{n}"))
    met = neighbours.join(of(1, "i"), ["struct_id", "i"]).join(of(2, "j"), ["struct_id", "j"])
    return met.where("mol_idx1 <> mol_idx2")


def molecule_displacements(first: DataFrame, second: DataFrame, mols: DataFrame) -> DataFrame:
    """struct_id, mol_idx, displacement: the mean distance of each molecule's atoms in two poses, met by index."""
    a = first.select("struct_id", "atom_idx", *(F.col(c).alias(f"{c}1") for c in "xyz"))
    b = second.select("struct_id", "atom_idx", *(F.col(c).alias(f"{c}2") for c in "xyz"))
    met = a.join(b, ["struct_id", "atom_idx"]).join(mols, ["struct_id", "atom_idx"])
    d = G.distance([F.col(f"{c}1") for c in "xyz"], [F.col(f"{c}2") for c in "xyz"])
    return met.groupBy("struct_id", "mol_idx").agg(F.avg(d).alias("displacement"))
