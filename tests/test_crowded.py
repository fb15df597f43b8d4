"""Structures whose atoms are nearly all bonded."""

import numpy as np
from pyspark.sql import functions as F

from orbisect.operators import graph, networks, pairs

ATOM = "struct_id string, atom_idx int, element string, x double, y double, z double"


def crowd(spark):
    """Two crowds far apart, atoms alone, and a structure of few atoms."""
    rng = np.random.default_rng(5)
    places = np.vstack([rng.uniform(0, 2, (200, 3)), rng.uniform(0, 2, (150, 3)) + 8, rng.uniform(0, 1, (4, 3)) + [[4, 0, k * 3] for k in range(4)]])
    rows = [("a", int(k), "CNOH"[k % 4], *map(float, p)) for k, p in zip(rng.permutation(354), places, strict=True)]
    return spark.createDataFrame(rows + [("b", k, "C", 1.4 * (k + k // 2), 0.0, 0.0) for k in range(6)], ATOM)


def test_molecules_of_a_crowd_need_few_bonds(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HELD", 3000)
    atoms = crowd(spark)
    every, some = pairs.bonds(atoms).cache(), pairs.bond_trees(atoms).cache()
    assert some.where("struct_id = 'a'").count() < 354 < every.count() / 20
    assert some.join(every, ["struct_id", "i", "j"], "left_anti").count() == 0
    told = lambda b: sorted(map(tuple, graph.molecules(atoms, b).collect()))
    assert told(some) == told(every) and len({m for s, _, m in told(some) if s == "a"}) > 2


def test_atoms_of_one_molecule_do_not_meet(spark, monkeypatch):
    """Contacts are those among all near pairs, and only pairs of two molecules are listed."""
    atoms = crowd(spark)
    mols = graph.molecules(atoms, pairs.bonds(atoms)).cache()
    near = pairs.within(atoms, 4.0, 4.0, ordered=True).select("*", *(F.lit(0).alias(c) for c in ("na", "nb", "nc")))
    want = pairs.contacts(near, mols.select("*", *(F.lit(0).alias(c) for c in ("sa", "sb", "sc"))), 1.3)
    listed, plain = [], pairs.within
    monkeypatch.setattr(pairs, "within", lambda *a, **k: listed.append(plain(*a, **k).count()) or plain(*a, **k))
    found = pairs.molecule_contacts(atoms, mols, 4.0, 1.3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 0
    assert listed[0] < near.count() / 10


def test_walks_find_what_stars_find(spark, monkeypatch):
    """Molecules and cells of made-up networks, finite and endless, loops at an atom alone; small ones need no rounds."""
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", int(i), int(j), *map(int, rng.integers(-1, 2, 3) if k % 3 else (i % 2 - j % 2, 0, i - j))) for k in range(30) for i, j in rng.integers(0, 9, (3 + k % 5, 2))]
    atoms = spark.createDataFrame([(f"s{k}", i) for k in range(30) for i in range(9)], "struct_id string, atom_idx int")
    links = spark.createDataFrame(rows, "struct_id string, i int, j int, na int, nb int, nc int").where("i <> j OR na <> 0 OR nb <> 0 OR nc <> 0")
    stars = sorted(map(tuple, networks.molecules(atoms, links, most=4).collect()))
    monkeypatch.setattr(networks, "connected", None)
    found = networks.molecules(atoms, links)
    assert sorted(map(tuple, found.collect())) == stars and {x.periodicity for x in found.collect()} >= {0, 1, 2}


def test_images_reach_as_far_as_own_bonds(spark, monkeypatch):
    """A structure without large atoms is not met as if it had some."""
    reached, plain = [], pairs.images
    monkeypatch.setattr(pairs, "images", lambda *a: reached.append(plain(*a)) or reached[-1])
    atoms = spark.createDataFrame([("a", 0, "C", 0.1, 0.1, 0.1), ("a", 1, "C", 3.9, 0.1, 0.1)], ATOM)
    cell = spark.createDataFrame([("a", [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]])], "struct_id string, lattice array<array<double>>")
    assert sorted((x.i, x.j, x.na) for x in pairs.periodic_bonds(atoms, cell).collect()) == [(0, 1, -1), (1, 0, 1)]
    assert reached[0].count() < 30
