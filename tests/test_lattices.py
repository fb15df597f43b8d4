from itertools import product

import numpy as np
import pytest

from orbisect.operators import crystals, lattices
from orbisect.operators.structures import STRUCTURE_SCHEMA


def minima(rows):
    """Lengths of the shortest independent vectors, from all sums of a cell that was made less long step by step."""
    rows = rows.copy()
    moved = True
    while moved:
        moved = False
        for i, j in product(range(3), repeat=2):
            if i != j and (k := round(rows[i] @ rows[j] / (rows[j] @ rows[j]))):
                less = rows[i] - k * rows[j]
                if less @ less < rows[i] @ rows[i] - 1e-12:
                    rows[i], moved = less, True
    every = np.array(list(product(range(-5, 6), repeat=3))) @ rows
    every = every[np.argsort((every**2).sum(1), kind="stable")][1:]
    out = [every[0]]
    for v in every[1:]:
        if np.linalg.matrix_rank(np.array([*out, v]), tol=1e-6) > len(out):
            out.append(v)
        if len(out) == 3:
            return [float(np.linalg.norm(v)) for v in out]


def unimodular(r, size=3):
    out = np.eye(3, dtype=int)
    for _ in range(4):
        i, j = r.choice(3, 2, replace=False)
        step = np.eye(3, dtype=int)
        step[i, j] = r.integers(-size, size + 1)
        out = step @ out
    return out


def written_anew(r, cell, elements, fractions, times):
    """The crystal in another cell, `times` as large along each edge, its origin moved, its atoms in another order."""
    s = np.diag(times) @ unimodular(r)
    large, inverse = s @ cell, np.linalg.inv(s)
    n = abs(round(np.linalg.det(s)))
    shifts = {tuple(np.round((np.array(x) @ inverse) % 1, 9) % 1) for x in product(range(-n, n + 1), repeat=3)} if n > 1 else {(0.0, 0.0, 0.0)}
    assert len(shifts) == n
    move = r.random(3) * 3
    atoms = [(e, np.array(t) @ large + f @ cell + move) for t in sorted(shifts) for e, f in zip(elements, fractions, strict=True)]
    atoms = [atoms[k] for k in r.permutation(len(atoms))]
    return [str(e) for e, _ in atoms], [p.tolist() for _, p in atoms], large.tolist()


def random_cell(r):
    while True:
        cell = r.normal(size=(3, 3)) * 3
        if abs(np.linalg.det(cell)) > 8 and minima(cell)[0] > 1.5:
            return cell


def test_measures_depend_on_the_lattice_alone(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(36):
        cell, n = random_cell(r), int(r.integers(1, 4))
        elements, f = list(r.choice(["C", "N"], n)), r.random((n, 3))
        times = (1, 1, 1) if k % 3 else tuple(map(int, r.choice([1, 2, 3], 3, p=[0.5, 0.35, 0.15])))
        rows.append((str(k), *written_anew(r, cell, elements, f, times), {}))
        want[str(k)] = n, [*minima(cell), *(1 / x for x in minima(np.linalg.inv(cell).T)), abs(np.linalg.det(cell)) ** (1 / 3)]
    got = {x.struct_id: (x.n_atoms, x.measures) for x in lattices.measured(spark.createDataFrame(rows, STRUCTURE_SCHEMA).repartition(6)).collect()}
    assert got.keys() == want.keys()
    for k, (n, measures) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(measures, rel=1e-6), k


def test_bands_miss_no_strained_lattice(spark):
    """Every pair whose lattices a strain within the bound takes to each other is found: random strains up to it, in cells
    that are permuted, skewed, doubled and shifted; and what is found is what comparing all pairs finds."""
    r, strain = np.random.default_rng(2), 0.08
    rows, kin = [], {}
    for k in range(14):
        cell, f = random_cell(r), r.random((2, 3))
        for m in range(3):
            u, _, v = np.linalg.svd(r.normal(size=(3, 3)))
            # Factors of the square root of the bound each, so that any two differ by the bound at most.
            map_ = u @ np.diag(np.exp(r.uniform(-1, 1, 3) * np.log1p(strain) / 2)) @ v
            rows.append((f"{k}-{m}", *written_anew(r, cell @ map_, ["C", "N"], f, (1, 1, 1) if m < 2 else (1, 2, 1)), {}))
            kin[f"{k}-{m}"] = k
    measured = lattices.measured(spark.createDataFrame(rows, STRUCTURE_SCHEMA).repartition(6)).cache()
    found = {(x.id1, x.id2) for x in lattices.alike(measured, strain).collect()}
    assert {(a, b) for a in kin for b in kin if a < b and kin[a] == kin[b]} <= found
    m = {x.struct_id: np.array(x.measures) for x in measured.collect()}
    assert found == {(a, b) for a in m for b in m if a < b and np.exp(np.abs(np.log(m[a] / m[b])).max()) - 1 <= strain}
    assert {(x.id1, x.id2) for x in lattices.alike(measured.withColumn("is_new", measured.struct_id == "3-1"), strain).collect()} == {p for p in found if "3-1" in p}


def test_duplicates_in_other_cells(spark):
    """A molecule's crystal strained by 2 %, doubled, skewed, shifted and mirrored is a duplicate; one with the molecule turned
    or in another box is none. The same as comparing the clusters of all pairs."""
    from orbisect.functions import numerics as N

    r = np.random.default_rng(4)
    cell = np.array([[5.1, 0.0, 0.0], [0.7, 6.0, 0.0], [-0.4, 0.9, 7.3]])
    water = np.array([[0.0, 0.0, 0.0], [0.757, 0.586, 0.1], [-0.757, 0.586, 0.2]])
    elements = ["O", "H", "H"]
    put = lambda mol, cell, times=(1, 1, 1): written_anew(r, cell, elements, mol @ np.linalg.inv(cell), times)
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    made = {"a": put(water, cell), "b": put(water, cell * 1.02), "c": put(water, cell, (2, 1, 1)), "d": put(water * [1, 1, -1], cell * [1, 1, -1]), "e": put(water @ turn, cell), "f": put(water, np.diag([4.2, 8.0, 6.6]))}
    df = spark.createDataFrame([(k, *v, {}) for k, v in made.items()], STRUCTURE_SCHEMA)
    found = {(x.id1, x.id2) for x in crystals.duplicates(df, strain=0.1, rmsd=0.3).where("is_match").collect()}
    assert found == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    apart = lambda x, y: N.crystal_rmsd((np.array(x[1]), x[0], np.array(x[2])), (np.array(y[1]), y[0], np.array(y[2])), 8, True)
    assert found == {(a, b) for a in made for b in made if a < b and apart(made[a], made[b]) < 0.3}
    assert {(x.leader, x.member) for x in crystals.unique(df, compare=lambda d: crystals.duplicates(d, 0.1, 0.3)).collect()} == {("a", m) for m in "abcd"} | {("e", "e"), ("f", "f")}


def test_odd_structures(spark):
    cell = [[3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0]]
    rows = [("flat", ["C"], [[0.0, 0.0, 0.0]], [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], {}), ("none", [], [], cell, {}), ("molecule", ["C"], [[0.0, 0.0, 0.0]], [], None)]
    rows += [("null", None, None, None, None), ("x", ["C"], [[1.0, 1.0, 1.0]], cell, {}), ("x", ["C"], [[1.0, 1.0, 1.0]], cell, {}), ("left", ["C"], [[0.0, 0.0, 0.0]], [[0.0, 3.0, 0.0], [3.0, 0.0, 0.0], [90.0, 30.0, 3.0]], {})]
    df = spark.createDataFrame(rows, STRUCTURE_SCHEMA)
    got = sorted((x.struct_id, x.n_atoms, [round(m, 6) for m in x.measures]) for x in lattices.measured(df).collect())
    assert got == [("left", 1, [3.0] * 7), ("x", 1, [3.0] * 7), ("x", 1, [3.0] * 7)]
    assert {(x.id1, x.id2) for x in lattices.alike(lattices.measured(df), 0.01).collect()} == {("left", "x")}
    assert lattices.alike(lattices.measured(df.limit(0)), 0.1).collect() == []
