"""Operators that go in rounds, against plain versions."""

import random
from itertools import product

import numpy as np
import pytest

from orbisect.operators import dedup, graph, pairs

POINTS = "struct_id string, atom_idx int, x double, y double, z double"
LATTICES = "struct_id string, lattice array<array<double>>"


def test_nearest_in_cells_of_any_shape(spark):
    """Flat, long, skewed and crowded cells; more neighbours than a cell holds; repeated points."""
    r = np.random.default_rng(3)
    cells = {"cube": np.eye(3) * 5, "flat": np.diag([2.0, 30.0, 30.0]), "long": np.diag([3.0, 3.0, 60.0]), "skew": np.array([[4.0, 0, 0], [9.0, 5.0, 0], [3.0, 22.0, 6.0]]), "left": np.diag([-4.0, 5.0, 6.0]), "crowd": np.eye(3) * 40.0}
    points, k = [], 9
    for name, cell in cells.items():
        n = 12 if name == "crowd" else int(r.integers(1, 6))
        f = r.random((n, 3)) * (0.05 if name == "crowd" else 3) - 1
        f[-1] = f[0] if name == "cube" else [0.5, 0.5, 0.5]
        points += [(name, i, *map(float, x)) for i, x in enumerate(f @ cell)]
    none = [("molecule", 0, 0.0, 0.0, 0.0)]
    lattices = spark.createDataFrame([(c, m.tolist()) for c, m in cells.items()] + [("molecule", [])], LATTICES)
    found = pairs.periodic_nearest(spark.createDataFrame(points + none, POINTS).repartition(4), lattices, k).collect()
    assert {x.struct_id for x in found} == set(cells)
    steps = np.array(list(product(range(-9, 10), repeat=3)))
    for name, cell in cells.items():
        own = np.array([p[2:] for p in points if p[0] == name])
        own = ((own @ np.linalg.inv(cell)) % 1.0) @ cell
        for i, p in enumerate(own):
            d = np.sort(np.linalg.norm((own[:, None] + (steps @ cell)[None]).reshape(-1, 3) - p, axis=1))[1 : k + 1]
            got = sorted((x for x in found if x.struct_id == name and x.i == i), key=lambda x: x.rank)
            assert [x.rank for x in got] == list(range(1, k + 1)) and [x.d for x in got] == pytest.approx(d, abs=1e-9), name
            for x in got:
                assert np.linalg.norm(own[x.j] + np.array([x.na, x.nb, x.nc]) @ cell - p) == pytest.approx(x.d, abs=1e-9)
    assert pairs.periodic_nearest(spark.createDataFrame(none, POINTS), lattices, 3).collect() == []


def classes(elements, links):
    """Refinement until no class is split, as a set of sets."""
    near = {i: set() for i in range(len(elements))}
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    c = dict(enumerate(elements))
    while True:
        new = {i: (c[i], tuple(sorted(map(repr, (c[j] for j in near[i]))))) for i in c}
        names = {v: k for k, v in enumerate(sorted(set(new.values()), key=repr))}
        new = {i: names[v] for i, v in new.items()}
        if len(set(new.values())) == len(set(c.values())):
            return {frozenset(i for i in c if c[i] == v) for v in c.values()}
        c = new


def test_refinement_goes_on_until_nothing_changes(spark):
    r = random.Random(4)
    graphs = {"path": (["C"] * 41, [(k, k + 1) for k in range(40)]), "ring": (["C"] * 12, [(k, (k + 1) % 12) for k in range(12)]), "lone": (["C", "N", "C"], []), "far": (["C"] * 40 + ["N"], [(k, k + 1) for k in range(40)])}
    for k in range(8):
        n = r.randint(2, 25)
        graphs[f"g{k}"] = ([r.choice("CNO") for _ in range(n)], [(r.randrange(m), m) for m in range(1, n)] + [tuple(r.sample(range(n), 2)) for _ in range(2)])
    order = r.sample(range(41), 41)
    graphs["again"] = ([graphs["far"][0][k] for k in order], [(order.index(a), order.index(b)) for a, b in graphs["far"][1]])
    atoms = spark.createDataFrame([(s, i, e) for s, (es, _) in graphs.items() for i, e in enumerate(es)], "struct_id string, atom_idx int, element string")
    bonds = spark.createDataFrame([(s, *p) for s, (_, ls) in graphs.items() for i, j in ls for p in ((i, j), (j, i), (i, j))], "struct_id string, i int, j int")
    found = graph.refined(atoms, bonds).cache()
    got = {}
    for x in found.collect():
        got.setdefault(x.struct_id, {}).setdefault(x.descriptor, set()).add(x.atom_idx)
    for s, (elements, links) in graphs.items():
        assert {frozenset(v) for v in got[s].values()} == classes(elements, links), s
    signs = {x.struct_id: x.signature for x in graph.graph_signature(found).collect()}
    assert signs["far"] == signs["again"] and len(set(signs.values())) == len(signs) - 1


@pytest.mark.parametrize("bins", [1, 3, 16])
def test_no_bin_holds_more_than_the_mean_and_a_job(spark, bins):
    r = random.Random(bins)
    for jobs in ([(k, int(10 ** r.uniform(0, 4))) for k in range(500)], [(k, 1) for k in range(7)], [(k, c) for k, c in enumerate([100_000] * 5 + [1] * 200)], [(k, 0) for k in range(9)], [(0, 5), (0, 5), (None, 7), (1, None)]):
        df = spark.createDataFrame(jobs, "id int, cost long").repartition(5)
        got = dedup.least_loaded(df, "cost", bins, "id").collect()
        assert sorted(map(str, ((x.id, x.cost) for x in got))) == sorted(map(str, jobs)) and all(0 <= x.part < bins for x in got)
        load = [0] * bins
        for x in got:
            load[x.part] += x.cost or 0
        costs = [c or 0 for _, c in jobs]
        assert max(load) <= sum(costs) / bins + max(costs)
        for x in got:
            if x.cost and x.cost * bins > sum(costs):
                assert [y for y in got if y.part == x.part and (y.cost or 0) > 0] == [x]
    assert dedup.least_loaded(spark.createDataFrame([], "id int, cost long"), "cost", 4, "id").collect() == []


def test_components_in_rows_and_in_rounds(spark):
    """Rows and rounds give the same molecules; atoms numbered otherwise than from 0 are told apart alike."""
    r = random.Random(6)
    links, atoms = [], []
    for s in range(15):
        n = r.randint(1, 60)
        own = r.sample(range(500), n) if s % 3 == 0 else list(range(n))
        atoms += [(str(s), k) for k in own]
        links += [(str(s), *r.sample(own, 2)) for _ in range(n * 2 // 3) if n > 1]
    links += [("4", k, k + 1) for k in range(0, 6)]
    df, bonds = spark.createDataFrame(atoms, "struct_id string, atom_idx int").repartition(4), spark.createDataFrame(links, "struct_id string, i int, j int")
    named = {(x.struct_id, x.atom_idx): x.mol_idx for x in graph.molecules(df, bonds).collect()}
    known = set(atoms)
    bonds = bonds.where(bonds.struct_id != "4") if not {("4", k) for k in range(7)} <= known else bonds
    for most in (0, 20, 1000):
        found = {(x.struct_id, x.atom_idx): x.mol_idx for x in graph.molecules(df, bonds, most=most).collect()}
        assert found.keys() == known
        for s in {a for a, _ in atoms}:
            own = [k for a, k in atoms if a == s]
            root = {k: k for k in own}

            def top(k, root=root):
                while root[k] != k:
                    k = root[k]
                return k

            for a, i, j in links:
                if a == s and (a != "4" or {("4", k) for k in range(7)} <= known):
                    root[max(top(i), top(j))] = min(top(i), top(j))
            heads = sorted({top(k) for k in own})
            assert {k: found[s, k] for k in own} == {k: heads.index(top(k)) for k in own}
    assert named.keys() == known


def test_shells_with_any_numbers(spark):
    atoms = spark.createDataFrame([("s", k, e, {"m": "1"}) for k, e in ((3, "C"), (7, "N"), (9, "O"), (20, "H"))], "struct_id string, atom_idx int, neighbourhood string, more map<string,string>")
    bonds = spark.createDataFrame([("s", 3, 7), ("s", 7, 3), ("s", 7, 9), ("s", 9, 7)], "struct_id string, i int, j int")
    got = {x.atom_idx: (x.descriptor, x.more["m"]) for x in graph.descriptors(atoms, bonds, 4).collect()}
    assert got == {3: ("C|N|O", "1"), 7: ("N|CO", "1"), 9: ("O|N|C", "1"), 20: ("H", "1")}
