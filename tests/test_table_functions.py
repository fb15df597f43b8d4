import pytest
from pyspark.sql import functions as F

from orbisect.operators import generators, pairs, structures
from orbisect.plans import table_functions
from orbisect.plans.chains import chain_crystals


@pytest.fixture(scope="module")
def crystals(spark, sf):
    table_functions.register(spark)
    atoms, lattices = chain_crystals(spark, sf)
    return atoms.cache(), lattices.cache()


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_supercells_as_by_the_dataframe_call(spark, crystals):
    atoms, lattices = crystals
    whole = structures.to_structures(atoms, lattices)
    columns = ["struct_id", "atom_idx", "element", "x", "y", "z", "src_atom_idx", "na", "nb", "nc"]
    got = spark.sql("SELECT * FROM supercell(TABLE({t}), 2, 1, 3)", t=whole)
    assert got.columns == columns and rows(got, *columns) == rows(generators.supercell(atoms, lattices, (2, 1, 3)), *columns)
    odd = whole.limit(1).withColumn("lattice", F.lit(None).cast("array<array<double>>"))
    assert spark.sql("SELECT * FROM supercell(TABLE({t}), 1, 1, 1)", t=odd).collect() == []
    assert spark.sql("SELECT * FROM supercell(TABLE({t}), 1, 1, 1)", t=whole.limit(0)).collect() == []


def test_pairs_as_by_the_dataframe_call(spark, crystals):
    atoms, _ = crystals
    got = spark.sql("SELECT * FROM pairs_within(TABLE({t}), 2.7D)", t=atoms.withColumn("more", F.lit(1)))
    assert rows(got, "struct_id", "i", "j", "d") == rows(pairs.within(atoms, 2.7, 2.7), "struct_id", "i", "j", "d") and got.count() > 20
    joined = spark.sql("SELECT p.struct_id, count(*) AS n FROM pairs_within(TABLE({t}), 1.4D) p JOIN {t} a ON a.struct_id = p.struct_id AND a.atom_idx = p.i GROUP BY p.struct_id", t=atoms)
    assert joined.count() == atoms.select("struct_id").distinct().count()


def test_first_atoms(spark, crystals):
    atoms, _ = crystals
    got = spark.sql("SELECT * FROM first_atoms(TABLE({t}), 2)", t=atoms.repartition(7))
    assert rows(got, "struct_id", "atom_idx") == rows(atoms.where("atom_idx < 2"), "struct_id", "atom_idx")


@pytest.mark.parametrize(("call", "said"), [("supercell(TABLE({t}), 0, 1, 1)", "1 or more"), ("supercell(TABLE({a}), 1, 1, 1)", "lacks elements"), ("pairs_within(TABLE({a}), -1)", "0 or more"), ("pairs_within(1, 2)", "is a table")])
def test_calls_are_checked_before_they_run(spark, crystals, call, said):
    atoms, lattices = crystals
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM {call}", t=structures.to_structures(atoms, lattices), a=atoms)
