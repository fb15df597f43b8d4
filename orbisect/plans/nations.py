"""Queries over small made-up molecules and crystals: a nation's suppliers are the atoms of one structure, in a box of five
Angstrom, so that bonds, contacts, molecules, files and drivers have rows that SQL can hold against theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..operators import graph, pairs, structures
from ..session import table, workspace, written
from ..sources import datasource, files
from ..streaming import incremental
from . import drivers
from .catalogue import query

SYMBOLS = ("C", "N", "O", "H")

SQL_NATIONS = """
atoms AS (
  SELECT s_nationkey::VARCHAR AS struct_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS atom_idx,
         (['C', 'N', 'O', 'H'])[s_suppkey % 4 + 1] AS element, (s_suppkey * 37 % 101)::DOUBLE / 20 AS x, (s_suppkey * 53 % 103)::DOUBLE / 20 AS y,
         (s_suppkey * 71 % 107)::DOUBLE / 20 AS z
  FROM supplier),
radii(element, cov, vdw) AS (VALUES """ + ", ".join(f"('{s}', {E.COVALENT[s]!r}::DOUBLE, {E.VDW[s]!r}::DOUBLE)" for s in SYMBOLS) + """),
pairs AS (
  SELECT a.struct_id, a.atom_idx AS i, b.atom_idx AS j, a.element AS e1, b.element AS e2, r.cov + s.cov AS cov, r.vdw + s.vdw AS vdw,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM atoms a JOIN atoms b ON a.struct_id = b.struct_id AND a.atom_idx <> b.atom_idx JOIN radii r ON r.element = a.element JOIN radii s ON s.element = b.element),
bonds AS (SELECT struct_id, i, j, d FROM pairs WHERE d <= 1.2 * cov)"""
SQL_COMPONENTS = """
reach AS (SELECT struct_id, atom_idx AS i, atom_idx AS j FROM atoms UNION SELECT reach.struct_id, reach.i, bonds.j FROM reach JOIN bonds ON reach.struct_id = bonds.struct_id AND reach.j = bonds.i),
roots AS (SELECT struct_id, i AS atom_idx, min(j) AS root FROM reach GROUP BY ALL),
mols AS (SELECT struct_id, atom_idx, (dense_rank() OVER (PARTITION BY struct_id ORDER BY root) - 1)::INTEGER AS mol_idx FROM roots)"""


def nation_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    place = lambda by, n: ((k * by) % n).cast("double") / 20
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("struct_id"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("atom_idx"),
        F.array(*(F.lit(s) for s in SYMBOLS))[(k % 4).cast("int")].alias("element"), place(37, 101).alias("x"), place(53, 103).alias("y"), place(71, 107).alias("z"),
    )


def nation_structures(spark: SparkSession, sf_dir: str, edge: float | None = None) -> DataFrame:
    """Molecules; with an edge, crystals in cubic cells of it."""
    atoms = nation_atoms(spark, sf_dir)
    if edge is None:
        return structures.to_structures(atoms)
    rows = F.array(*(F.array(*(F.lit(edge if i == j else 0.0) for j in range(3))) for i in range(3)))
    return structures.to_structures(atoms, atoms.select("struct_id").distinct().withColumn("lattice", rows))


@query(f"WITH {SQL_NATIONS} SELECT struct_id, i, j, round(d, 9) AS d FROM bonds")
def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.bonds(nation_atoms(spark, sf_dir), 1.2)
    return found.select("struct_id", "i", "j", F.round("d", 9).alias("d"))


@query(f"""WITH {SQL_NATIONS}, n AS (
  SELECT a.struct_id, a.atom_idx, a.element || coalesce(string_agg(b.element, '' ORDER BY b.element), '') AS neighbourhood
  FROM atoms a LEFT JOIN bonds ON bonds.struct_id = a.struct_id AND bonds.i = a.atom_idx LEFT JOIN atoms b ON b.struct_id = bonds.struct_id AND b.atom_idx = bonds.j
  GROUP BY a.struct_id, a.atom_idx, a.element)
SELECT struct_id, neighbourhood, count(*) AS n FROM n GROUP BY ALL""")
def bonded_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = nation_atoms(spark, sf_dir)
    return graph.fragments(graph.neighbourhoods(atoms, pairs.bonds(atoms, 1.2)))


@query(f"WITH RECURSIVE {SQL_NATIONS}, {SQL_COMPONENTS} SELECT struct_id, atom_idx, mol_idx FROM mols")
def found_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.FindMolecules(1.2)(nation_structures(spark, sf_dir)).select("struct_id", "atom_idx", F.col("mol_idx").cast("int").alias("mol_idx"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, {SQL_COMPONENTS}, n AS (SELECT struct_id, count(DISTINCT mol_idx) AS n_molecules FROM mols GROUP BY struct_id)
SELECT struct_id, n_molecules, n_molecules = 2 AS is_dimer FROM n""")
def dimers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nation_structures(spark, sf_dir)
    counted = graph.component_counts(drivers.FindMolecules(1.2)(rows)).join(rows.select("struct_id", "lattice"), "struct_id")
    return counted.select("struct_id", "n_molecules", graph.is_dimer().alias("is_dimer"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, {SQL_COMPONENTS}
SELECT struct_id || '_molecule_' || mol_idx AS struct_id, count(*) AS n_atoms, string_agg(element, '' ORDER BY atom_idx) AS elements
FROM mols JOIN atoms USING (struct_id, atom_idx) GROUP BY mols.struct_id, mol_idx""")
def molecules_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each molecule as a structure of its own."""
    rows = nation_structures(spark, sf_dir)
    parts = graph.molecule_structures(structures.to_atoms(rows), drivers.FindMolecules(1.2)(rows))
    out = structures.to_structures(parts)
    return out.select("struct_id", F.size("elements").cast("long").alias("n_atoms"), F.array_join("elements", "").alias("elements"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, steps AS (
  SELECT struct_id, i, j, 1 AS n FROM bonds UNION SELECT steps.struct_id, steps.i, bonds.j, n + 1 FROM steps JOIN bonds ON steps.struct_id = bonds.struct_id AND steps.j = bonds.i WHERE n < 3)
SELECT DISTINCT struct_id, i, j FROM steps WHERE i <> j""")
def within_three_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.within_bonds(pairs.bonds(nation_atoms(spark, sf_dir), 1.2), 3)


SQL_CONTACTS = """
contacts AS (
  SELECT p.struct_id, p.i, p.j, p.d, p.d / p.vdw AS ratio FROM pairs p JOIN mols a ON a.struct_id = p.struct_id AND a.atom_idx = p.i
  JOIN mols b ON b.struct_id = p.struct_id AND b.atom_idx = p.j WHERE a.mol_idx <> b.mol_idx AND p.d / p.vdw < 1.0 AND p.d <= 4.0)"""


def nation_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = nation_atoms(spark, sf_dir)
    mols = drivers.FindMolecules(1.2)(nation_structures(spark, sf_dir)).select("struct_id", "atom_idx", "mol_idx")
    return pairs.molecule_contacts(atoms, written(mols, workspace(spark, "contacts"), "molecules"), 4.0, 1.0)


@query(f"WITH RECURSIVE {SQL_NATIONS}, {SQL_COMPONENTS}, {SQL_CONTACTS} SELECT struct_id, i, j, round(d, 9) AS d, round(ratio, 9) AS ratio FROM contacts")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_contacts(spark, sf_dir).select("struct_id", "i", "j", F.round("d", 9).alias("d"), F.round("ratio", 9).alias("ratio"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, {SQL_COMPONENTS}, {SQL_CONTACTS}
SELECT struct_id, i, j, round(ratio, 9) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY struct_id ORDER BY ratio, i, j) AS n FROM contacts) WHERE n = 1""")
def closest_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.closest(nation_contacts(spark, sf_dir)).select("struct_id", "i", "j", F.round("ratio", 9).alias("ratio"))


@query(f"""WITH RECURSIVE {SQL_NATIONS}, {SQL_COMPONENTS}, {SQL_CONTACTS}
SELECT struct_id, i, j, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY struct_id ORDER BY ratio, i, j) AS n FROM contacts WHERE i < j) WHERE n <= 3""")
def closest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.closest_k(nation_contacts(spark, sf_dir), 3).select("struct_id", "i", "j", "rank")


#: Atoms with the neighbourhoods that hydrogen bonds go by, from two tables that share a nation.
KINDS = ("HO", "HN", "ON", "NC", "CH")
SQL_CUTOFFS = """
kinds AS (SELECT c_nationkey::VARCHAR AS struct_id, (c_custkey)::INTEGER AS i, (['HO', 'HN', 'ON', 'NC', 'CH'])[c_custkey % 5 + 1] AS k1, (c_custkey * 37 % 101)::DOUBLE / 20 AS x FROM customer),
others AS (SELECT s_nationkey::VARCHAR AS struct_id, (s_suppkey)::INTEGER AS j, (['HO', 'HN', 'ON', 'NC', 'CH'])[s_suppkey % 5 + 1] AS k2, (s_suppkey * 53 % 103)::DOUBLE / 20 AS x FROM supplier),
both_kinds AS (
  SELECT struct_id, i, j, k1, k2, abs(kinds.x - others.x) AS d, r.vdw + s.vdw AS own FROM kinds JOIN others USING (struct_id)
  JOIN radii r ON r.element = k1[1] JOIN radii s ON s.element = k2[1]),
cut AS (
  SELECT struct_id, i, j, d, CASE
    WHEN k1 = 'HO' AND k2[1] = 'O' OR k2 = 'HO' AND k1[1] = 'O' THEN 1.5::DOUBLE / 0.85::DOUBLE
    WHEN k1 IN ('HO', 'HN') AND k2[1] IN ('N', 'O') AND k1[2] <> k2[1] OR k2 IN ('HO', 'HN') AND k1[1] IN ('N', 'O') AND k2[2] <> k1[1] THEN 1.6::DOUBLE / 0.85::DOUBLE
    WHEN k1 = 'HN' AND k2[1] = 'N' OR k2 = 'HN' AND k1[1] = 'N' THEN 1.75::DOUBLE / 0.85::DOUBLE ELSE own END AS cutoff
  FROM both_kinds)"""


def nation_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def side(name: str, prefix: str, key: str, by: int, n: int) -> DataFrame:
        kind = F.array(*(F.lit(k) for k in KINDS))[(F.col(key) % 5).cast("int")]
        x = ((F.col(key) * by) % n).cast("double") / 20
        rows = table(spark, sf_dir, name).select(F.col(f"{prefix}_nationkey").cast("string").alias("struct_id"), F.col(key).cast("int").alias("atom_idx"), kind.alias("neighbourhood"), x.alias("x"))
        return rows.select("*", F.substring("neighbourhood", 1, 1).alias("element"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))

    return side("customer", "c", "c_custkey", 37, 101), side("supplier", "s", "s_suppkey", 53, 103)


@query(f"WITH {SQL_NATIONS}, {SQL_CUTOFFS} SELECT struct_id, i, j, round(cutoff, 9) AS cutoff, round(d, 9) AS d FROM cut")
def hydrogen_bond_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with each supplier of its nation; values are found and rounded once for what lies at one place."""
    met = pairs.place_cutoffs(*nation_sides(spark, sf_dir))
    return pairs.each_pair(met.select("struct_id", "i", "j", F.round("cutoff", 9).alias("cutoff"), F.round("d", 9).alias("d")))


@query(f"""WITH {SQL_NATIONS}, {SQL_CUTOFFS}, least_of AS (SELECT struct_id, min(d / cutoff) AS m FROM cut GROUP BY struct_id)
SELECT struct_id, round(m, 9) AS min_ratio, m >= 0.001::DOUBLE AND m <= 0.01::DOUBLE AS ok FROM least_of""")
def distances_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = nation_sides(spark, sf_dir)
    return pairs.distance_check(pairs.cutoffs(pairs.places(first), pairs.places(second)), 0.001, 0.01).withColumn("min_ratio", F.round("min_ratio", 9))


@query(f"""WITH {SQL_NATIONS}, f AS (SELECT struct_id, count(*) AS n_atoms, string_agg(element, '' ORDER BY atom_idx) AS elements, round(sum(x), 4) AS x, round(sum(y * (atom_idx + 1)), 4) AS y FROM atoms GROUP BY struct_id)
SELECT unnest(['json', 'xyz', 'geometry']) AS file_format, * FROM f""")
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures written as files of three formats and read back from them."""
    folder, rows = workspace(spark, "files"), nation_structures(spark, sf_dir)
    files.write_formats(rows, folder, ("json", "xyz", "geometry"))
    back = None
    for kind in ("json", "xyz", "geometry"):
        one = files.read_dictionary(spark, f"{folder}/{kind}").withColumn("file_format", F.lit(kind))
        back = one if back is None else back.unionByName(one)
    ids = F.regexp_replace("struct_id", "_0$", "")
    total = lambda f: F.round(F.aggregate("geometry", F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("n")), lambda a, p: F.struct((a["s"] + f(p, a["n"])).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"]), 4)
    return back.select("file_format", ids.alias("struct_id"), F.size("elements").cast("long").alias("n_atoms"), F.array_join("elements", "").alias("elements"), total(lambda p, n: p[0]).alias("x"), total(lambda p, n: p[1] * n).alias("y"))


@query(f"WITH {SQL_NATIONS} SELECT struct_id, 2 * count(*) AS n, round(2 * sum(x) + 10 * count(*), 6) AS x FROM atoms GROUP BY struct_id")
def folder_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A driver over a folder of files, run twice: the second run finds all done."""
    folder = workspace(spark, "run")
    files.write(nation_structures(spark, sf_dir, 10.0), f"{folder}/in")
    driver = drivers.from_settings({"driver": "Supercell", "settings": {"mult": [2, 1, 1]}})
    run = drivers.FolderRun(driver, f"{folder}/in", f"{folder}/out")
    run.calc(spark)
    return run.calc(spark).groupBy("struct_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x"))


@query(f"""WITH e(symbol, z, mass, cov) AS (VALUES {", ".join(f"('{s}', {z}, {m!r}::DOUBLE, {c!r}::DOUBLE)" for s, z, m, c, *_ in E.ELEMENTS)})
SELECT p_brand AS brand, count(*) AS n, round(sum(mass), 6) AS mass, round(sum(cov), 6) AS radius, sum(z)::BIGINT AS z, min(symbol) AS first
FROM part JOIN e ON z = p_partkey % 96 + 1 GROUP BY p_brand""")
def all_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element by its number: symbols, masses and radii."""
    symbol = E.symbol((F.col("p_partkey") % 96 + 1).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_brand", symbol.alias("e"))
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(
        F.count("*").alias("n"), F.round(F.sum(E.mass(F.col("e"))), 6).alias("mass"), F.round(F.sum(E.covalent(F.col("e"))), 6).alias("radius"),
        F.sum(E.number(F.col("e"))).alias("z"), F.min("e").alias("first"),
    )


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return incremental.newest(rows, "user_id", "event_id")


@query(f"""WITH {SQL_NATIONS} SELECT struct_id, count(*) AS n_atoms, round(sum(x), 6) AS x FROM atoms WHERE struct_id IN ('1', '3', '5', '7', '11', '20') GROUP BY struct_id""")
def source_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structures written as two runs of the data source, then those of some ids read from the files that the filter leaves."""
    datasource.register(spark)
    rows = nation_structures(spark, sf_dir)
    at = workspace(spark, "source")
    for part in (rows.where("struct_id < '2'"), rows.where("struct_id >= '2'")):
        part.write.format("structures").mode("append").save(at)
    back = spark.read.format("structures").load(at).where(F.col("struct_id").isin("1", "3", "5", "7", "11", "20"))
    return back.select("struct_id", F.size("elements").cast("long").alias("n_atoms"), F.round(F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p[0]), 6).alias("x"))
