import random
from collections import deque

import numpy as np
import pytest

from orbisect.operators import networks, pairs

LINKS = "struct_id string, i int, j int, na int, nb int, nc int"


def plain(n, links):
    """Walks from the least atom of each component; the rank of what closed walks add up to."""
    near = {k: [] for k in range(n)}
    for i, j, v in links:
        near[i].append((j, np.array(v)))
        near[j].append((i, -np.array(v)))
    out, mols = {}, 0
    for root in range(n):
        if root in out:
            continue
        cells, loops, todo = {root: np.zeros(3, int)}, [], deque([root])
        while todo:
            k = todo.popleft()
            for j, v in near[k]:
                if j not in cells:
                    cells[j] = cells[k] + v
                    todo.append(j)
                else:
                    loops.append(cells[k] + v - cells[j])
        rank = int(np.linalg.matrix_rank(np.array(loops))) if loops else 0
        for k, cell in cells.items():
            out[k] = (mols, *((0, 0, 0) if rank else map(int, cell)), rank)
        mols += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_as_walks(spark, seed):
    """Trees whose links cross faces at random have no end only where further links don't agree with them."""
    r = random.Random(seed)
    rows, want, atoms = [], {}, []
    for s in range(12):
        n = r.randint(1, 40)
        cell = {k: [r.randint(-2, 2) for _ in range(3)] for k in range(n)}
        links = []
        for k in range(1, n):
            if r.random() < 0.85:
                j = r.randrange(max(0, k - 3), k)
                links.append((j, k, [b - a for a, b in zip(cell[j], cell[k], strict=True)]))
        links += [links[r.randrange(len(links))] for _ in range(3) if links]
        for _ in range(r.choice([0, 0, 0, 1, 2, 4]) if n > 1 else 0):
            links.append((r.randrange(n), r.randrange(n), [r.randint(-1, 1) for _ in range(3)]))
        links = [x for x in links if x[0] != x[1] or any(x[2])]
        back = r.random() < 0.5
        rows += [(str(s), i, j, *map(int, v)) for i, j, v in links] + [(str(s), j, i, *(-int(x) for x in v)) for i, j, v in links if back]
        atoms += [(str(s), k) for k in range(n)]
        want |= {(str(s), k): v for k, v in plain(n, links).items()}
    found = networks.molecules(spark.createDataFrame(atoms, "struct_id string, atom_idx int"), spark.createDataFrame(rows, LINKS).repartition(5))
    got = {(x.struct_id, x.atom_idx): (x.mol_idx, x.sa, x.sb, x.sc, x.periodicity) for x in found.collect()}
    assert got == want


def test_a_long_chain_and_loops_alone(spark):
    n = 600
    rows = [("c", k, k + 1, 1 if k % 7 == 0 else 0, 0, -1 if k % 11 == 0 else 0) for k in range(n - 1)] + [("l", 0, 0, 0, 1, 0), ("l", 1, 1, 1, 0, 0), ("l", 1, 1, 0, 0, 1)]
    atoms = [("c", k) for k in range(n)] + [("l", k) for k in range(3)]
    found = networks.molecules(spark.createDataFrame(atoms, "struct_id string, atom_idx int"), spark.createDataFrame(rows, LINKS))
    got = {(x.struct_id, x.atom_idx): (x.mol_idx, x.sa, x.sb, x.sc, x.periodicity) for x in found.collect()}
    assert all(got["c", k] == (0, sum(m % 7 == 0 for m in range(k)), 0, -sum(m % 11 == 0 for m in range(k)), 0) for k in range(n))
    assert [got["l", k] for k in range(3)] == [(0, 0, 0, 0, 1), (1, 0, 0, 0, 2), (2, 0, 0, 0, 0)]
    none = networks.molecules(spark.createDataFrame([], "struct_id string, atom_idx int"), spark.createDataFrame([], LINKS))
    assert none.collect() == []


def test_whole_molecules_are_in_one_piece(spark):
    """After they are moved, bonded atoms lie as near as their bond is long."""
    from pyspark.sql import functions as F

    from orbisect.plans.chains import chain_crystals

    atoms, lattices = chain_crystals(spark, "/root/testdata/sf0.001")
    bonds = pairs.periodic_bonds(atoms, lattices, 1.2).cache()
    found = networks.molecules(atoms, bonds).cache()
    assert found.where("sa <> 0 OR sb <> 0 OR sc <> 0").count() > 5 and found.where("periodicity > 0").count() > 0
    put = networks.whole(atoms, lattices, found)
    at = lambda k, n: put.select("struct_id", F.col("atom_idx").alias(k), *(F.col(c).alias(f"{c}{n}") for c in "xyz"))
    finite = found.where("periodicity = 0").select("struct_id", F.col("atom_idx").alias("i"))
    met = bonds.join(finite, ["struct_id", "i"]).join(at("i", 1), ["struct_id", "i"]).join(at("j", 2), ["struct_id", "j"])
    far = met.select(F.max(F.abs(F.expr("sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))") - F.col("d")))).first()[0]
    assert far < 1e-9


def test_whole_molecules_have_their_centres_in_the_cell(spark):
    """As the same work on one crystal at a time has it: heavy ends beyond a face take the molecule with them."""
    from orbisect.functions import numerics as N

    cell = np.array([[5.0, 0.0, 0.0], [0.6, 5.0, 0.0], [0.0, 0.0, 6.0]])
    places = {"a": [("C", 0.1, 2.0, 2.0), ("O", 4.0, 2.0, 2.0)], "b": [("O", 0.1, 4.9, 5.9), ("C", 0.1, 4.9, 1.1)], "c": [("Qq", 4.9, 1.0, 1.0), ("N", 1.0, 1.0, 1.0)]}
    atoms = spark.createDataFrame([(s, k, *a) for s, rows in places.items() for k, a in enumerate(rows)], "struct_id string, atom_idx int, element string, x double, y double, z double")
    lattices = spark.createDataFrame([(s, cell.tolist()) for s in places], "struct_id string, lattice array<array<double>>")
    found = networks.molecules(atoms, pairs.periodic_bonds(atoms, lattices, 1.2))
    put = {(r.struct_id, r.atom_idx): (r.x, r.y, r.z) for r in networks.whole(atoms, lattices, found).collect()}
    for s in "ab":
        want, groups = N.whole_molecules(np.array([a[1:] for a in places[s]]), [a[0] for a in places[s]], cell)
        assert len(groups) == 1 and np.allclose([put[s, k] for k in range(2)], want)
    assert np.allclose([put["a", k][0] for k in range(2)], [5.1, 4.0])
    assert np.allclose([put["c", k] for k in range(2)], [a[1:] for a in places["c"]])
