import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisect.functions import elements as E
from orbisect.functions import geometry as G
from orbisect.functions import numerics as N
from orbisect.operators import dedup, generators, graph, pairs, structures
from orbisect.streaming import incremental

ATOM = "struct_id string, atom_idx int, element string, x double, y double, z double"
LATTICE = "struct_id string, lattice array<array<double>>"


def cloud(spark, n=60, seed=0, size=8.0, ids=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [(s, k, str(rng.choice(["C", "N", "O", "H"])), *map(float, rng.random(3) * size)) for s in ids for k in range(n)]
    return spark.createDataFrame(rows, ATOM), rows


def test_distance_join_finds_what_brute_force_finds(spark):
    df, rows = cloud(spark)
    got = {(r.struct_id, r.i, r.j) for r in pairs.within(df, 1.5, 1.5).collect()}
    near = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.dist(a[3:], b[3:]) <= 1.5}
    assert got == near and near


def test_periodic_neighbours_find_what_brute_force_finds(spark):
    lattice = [[6.0, 0.0, 0.0], [1.5, 5.0, 0.0], [0.7, -0.9, 7.0]]
    df, rows = cloud(spark, 12, 3, 6.0, ("a",))
    lats = spark.createDataFrame([("a", lattice)], LATTICE)
    got = pairs.periodic_neighbours(df, lats, 3.0, 3.0).groupBy("i").agg(F.count("*").alias("n"), F.min("d").alias("d")).collect()
    lat = np.array(lattice)
    want = {}
    for a in rows:
        ds = [np.linalg.norm(np.array(b[3:]) + np.array([i, j, k]) @ lat - np.array(a[3:])) for b in rows for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4)]
        ds = [d for d in ds if 1e-9 < d < 3.0]
        want[a[1]] = (len(ds), min(ds))
    assert {r.i: (r.n, pytest.approx(r.d)) for r in got} == want


def test_pairs_are_each_met_once(spark):
    rows = spark.createDataFrame([(i,) for i in range(40)], "k int")
    got = [(r.id1, r.id2) for r in pairs.unordered(rows, "k").collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 and all(a < b for a, b in got)
    assert pairs.both_sides(pairs.unordered(rows, "k")).count() == 40 * 39


def test_fractions_come_back(spark):
    lattice = [[6.0, 0.0, 0.0], [1.5, 5.0, 0.0], [0.7, -0.9, 7.0]]
    df, rows = cloud(spark, 10, 1, 20.0, ("a",))
    lats = spark.createDataFrame([("a", lattice)], LATTICE)
    f = structures.fractional(df, lats, inside=True).collect()
    want = np.array([r[3:] for r in rows]) @ np.linalg.inv(np.array(lattice)) % 1.0
    assert np.allclose([[r.fa, r.fb, r.fc] for r in sorted(f, key=lambda r: r.atom_idx)], want)
    cell = structures.cells(lats).first()
    assert cell.volume == pytest.approx(np.linalg.det(np.array(lattice)))


def test_wrapping_with_slack(spark):
    eye = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    v = [F.lit(-0.00005), F.lit(-0.3), F.lit(2.25)]
    got = spark.range(1).select(*G.to_cartesian(v, eye, inside=True)).first()
    assert list(got) == pytest.approx([-0.00005, 0.7, 0.25])


def test_invariants_of_moves(spark):
    df, _ = cloud(spark, 20, 2)
    moved = structures.translated(structures.rotated(df, G.euler_matrix(20, 40, 60)), (1.0, 2.0, 3.0))
    trace = lambda d: sorted((r.struct_id, pytest.approx(r.ixx + r.iyy + r.izz)) for r in structures.inertia(structures.centred(d)).collect())
    assert [tuple(x) for x in trace(df)] == [tuple(x) for x in trace(moved)]
    assert structures.formulas(df).collect() == structures.formulas(moved).collect()
    assert pairs.bonds(df).count() == pairs.bonds(moved).count()


def test_wrapping_and_boxes(spark):
    df, _ = cloud(spark, 5, 4)
    box = structures.boxed(df).groupBy("struct_id").agg(F.min("x"), F.max("box_x")).collect()
    assert all(r[1] == 0 and r[2] >= 40 for r in box)


def test_rows_and_arrays(spark):
    df, _ = cloud(spark, 6, 5)
    rows = structures.to_structures(df)
    assert sorted(map(tuple, structures.to_atoms(rows).collect())) == sorted(map(tuple, df.collect()))
    assert structures.valid(rows).count() == 2
    label = {r.label for r in structures.described(rows).collect()}
    assert all(": Molecule " in x for x in label)
    named = structures.content_id(rows.withColumn("struct_id", F.lit("")))
    assert [r.struct_id for r in named.collect()] == [r.struct_id for r in named.collect()]
    put = structures.with_property(rows, "energy", F.lit(1.5))
    assert structures.property_table(put, ["energy", "none"], "double").first()[1:] == (1.5, None)
    assert structures.without_property(put, "energy").first().properties == {}


def test_components_and_fragments(spark):
    rows = [("s", 0, "C", 0.0, 0.0, 0.0), ("s", 1, "O", 1.2, 0.0, 0.0), ("s", 2, "H", 9.0, 0.0, 0.0), ("s", 3, "H", 9.5, 0.0, 0.0), ("t", 0, "C", 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, ATOM)
    bonds = pairs.bonds(atoms)
    got = sorted((r.struct_id, r.atom_idx, r.mol_idx) for r in graph.molecules(atoms, bonds).collect())
    assert got == [("s", 0, 0), ("s", 1, 0), ("s", 2, 1), ("s", 3, 1), ("t", 0, 0)]
    named = graph.neighbourhoods(atoms, bonds)
    assert {(r.struct_id, r.atom_idx): r.neighbourhood for r in named.collect()} == {("s", 0): "CO", ("s", 1): "OC", ("s", 2): "HH", ("s", 3): "HH", ("t", 0): "C"}
    two = graph.component_counts(graph.molecules(atoms, bonds))
    assert {r.struct_id: r.n_molecules for r in two.collect()} == {"s": 2, "t": 1}


def test_triangle_angles_are_counted_once(spark):
    rows = [("s", k, "C", *p) for k, p in enumerate([(0.0, 0.0, 0.0), (1.5, 0.0, 0.0), (0.75, 1.3, 0.0)])]
    atoms = spark.createDataFrame(rows, ATOM)
    bonds = pairs.bonds(atoms)
    assert graph.bond_angles(atoms, bonds, unique=False).count() == 3
    assert [r.centre for r in graph.bond_angles(atoms, bonds).collect()] == [0]


def greedy(n, links):
    used, out = set(), []
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for i in range(n):
        if i not in used:
            out.append(i)
            used |= near[i]
    return out, near


@pytest.mark.parametrize("seed", range(4))
def test_leaders_are_the_sequential_ones(spark, seed):
    rng = np.random.default_rng(seed)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2)) if a != b}
    nodes = spark.createDataFrame([(i, i) for i in range(40)], "id int, ord int")
    edges = spark.createDataFrame(sorted(links), "id1 int, id2 int")
    want, near = greedy(40, links)
    assert sorted(r.id for r in dedup.leaders(nodes, edges).collect()) == want
    kept = {(r.leader, r.member) for r in dedup.unique(nodes, edges, True).collect()}
    assert kept == {(i, j) for i in want for j in near[i] | {i}}
    short = {(r.leader, r.member) for r in dedup.unique(nodes, edges, False).collect()}
    assert short == {(i, j) for i, j in kept if near[i]}
    first = {r.id: r.leader for r in dedup.assigned(nodes, edges).collect()}
    assert first == {i: i if i in want else min(w for w in want if w in near[i]) for i in range(40)}


def test_balanced_parts(spark):
    jobs = spark.createDataFrame([(k, c) for k, c in enumerate([9, 7, 7, 5, 3, 3, 2, 1])], "k int, cost int")
    sums = [r[1] for r in dedup.balanced(jobs, "cost", 2, "k").groupBy("part").agg(F.sum("cost")).collect()]
    assert abs(sums[0] - sums[1]) <= 9


def test_packing_is_the_share_of_points(spark):
    lattice = [[4.0, 0.0, 0.0], [0.5, 5.0, 0.0], [0.2, 0.3, 4.5]]
    atoms = spark.createDataFrame([("s", 0, "C", 0.5, 0.4, 0.3), ("s", 1, "H", 2.5, 3.0, 2.0)], ATOM)
    lats = spark.createDataFrame([("s", lattice)], LATTICE)
    got = generators.packing(atoms, lats, 0.5).first()
    lat = np.array(lattice)
    n = np.linalg.norm(lat, axis=1) / 0.5
    grid = np.array([[i / n[0], j / n[1], k / n[2]] for i in range(math.ceil(n[0])) for j in range(math.ceil(n[1])) for k in range(math.ceil(n[2]))]) @ lat
    hit = np.zeros(len(grid), bool)
    for p, r in (((0.5, 0.4, 0.3), E.CONTACT["C"]), ((2.5, 3.0, 2.0), E.CONTACT["H"])):
        for s in np.ndindex(5, 5, 5):
            hit |= np.linalg.norm(grid - np.array(p) - (np.array(s) - 2) @ lat, axis=1) < r
    assert (got.points, got.occupied) == (len(grid), hit.sum())
    assert N.packing(np.array([[0.5, 0.4, 0.3], [2.5, 3.0, 2.0]]), ["C", "H"], lat, 0.5) == (len(grid), hit.sum())


def test_supercells(spark):
    atoms = spark.createDataFrame([("s", 0, "C", 0.5, 0.4, 0.3), ("s", 1, "H", 2.5, 3.0, 2.0)], ATOM)
    lats = spark.createDataFrame([("s", [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 4.5]])], LATTICE)
    whole = generators.supercell(atoms, lats, (3, 2, 1))
    assert whole.count() == 12 and whole.select("atom_idx").distinct().count() == 12
    first = generators.centred_supercell(atoms, lats).orderBy("atom_idx").take(2)
    assert [(r.na, r.nb, r.nc) for r in first] == [(0, 0, 0)] * 2
    with pytest.raises(ValueError):
        generators.supercell(atoms, lats, (0, 1, 1))
    mols = spark.createDataFrame([("s", 0, 0), ("s", 1, 0)], "struct_id string, atom_idx int, mol_idx int")
    assert generators.com_supercell(atoms, lats, mols, 5.0).select("element").distinct().first()[0] == "Cu"
    assert generators.unit_cell_corners(lats).count() == 8


def test_contacts_know_images_of_their_own_molecule(spark):
    atoms = spark.createDataFrame([("s", 0, "C", 0.1, 0.0, 0.0), ("s", 1, "O", 1.3, 0.0, 0.0)], ATOM)
    lats = spark.createDataFrame([("s", [[4.2, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]])], LATTICE)
    mols = spark.createDataFrame([("s", 0, 0, 0, 0, 0), ("s", 1, 0, 0, 0, 0)], "struct_id string, atom_idx int, mol_idx int, sa int, sb int, sc int")
    found = pairs.contacts(pairs.periodic_neighbours(atoms, lats, 5.0, 5.0), mols).collect()
    assert {(r.i, r.j, r.na) for r in found} >= {(0, 1, -1), (1, 0, 1)} and all(r.na for r in found)
    least = pairs.closest(pairs.contacts(pairs.periodic_neighbours(atoms, lats, 5.0, 5.0), mols)).first()
    assert least.d == pytest.approx(3.0)


def test_hydrogen_bonds_shorten_cutoffs(spark):
    kind = f"{ATOM}, neighbourhood string"
    a = spark.createDataFrame([("d", 0, "H", 0.0, 0.0, 0.0, "HO"), ("d", 1, "O", -1.0, 0.0, 0.0, "OH")], kind)
    b = spark.createDataFrame([("d", 0, "N", 1.8, 0.0, 0.0, "NCC")], kind)
    got = {(r.i, r.j): r.cutoff for r in pairs.cutoffs(a, b).collect()}
    assert got[0, 0] == pytest.approx(1.6 / 0.85) and got[1, 0] == pytest.approx(E.VDW["O"] + E.VDW["N"])
    assert pairs.distance_check(pairs.cutoffs(a, b), 0.9, 1.3).first().ok


def test_remaining_and_restart(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(10)], "struct_id int")
    calls = []

    def calculate(todo):
        calls.append(todo.count())
        return todo.withColumn("value", F.col("struct_id") * 2)

    incremental.run_remaining(jobs.where("struct_id < 4"), str(tmp_path / "out"), calculate)
    out = incremental.run_remaining(jobs, str(tmp_path / "out"), calculate)
    assert calls == [4, 6] and out.count() == 10
    assert incremental.run_remaining(jobs, str(tmp_path / "out"), calculate).count() == 10 and calls[-1] == 0


def test_upsert_stream(spark, tmp_path):
    import json

    from orbisect.streaming.buckets import BucketTable

    folder = tmp_path / "in"
    folder.mkdir()
    schema = "struct_id string, energy double"
    for k, e in (("a", 1.0), ("b", 2.0)):
        (folder / f"{k}.json").write_text(json.dumps({"struct_id": k, "energy": e}))

    def go():
        stream = incremental.structure_stream(spark, str(folder), schema, 1)
        incremental.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
        return {r.struct_id: r.energy for r in BucketTable(str(tmp_path / "table")).read(spark).collect()}

    assert go() == {"a": 1.0, "b": 2.0}
    (folder / "c.json").write_text(json.dumps({"struct_id": "a", "energy": 5.0}))
    assert go() == {"a": 5.0, "b": 2.0}


def test_windowed_counts_as_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    as_rows = lambda df: sorted(map(tuple, df.withColumn("start", F.col("start").cast("string")).collect()))
    assert as_rows(spark.table("w")) == as_rows(batch)


@pytest.mark.parametrize("apart", [None, "element"])
def test_points_of_small_groups_meet_without_cells(spark, apart):
    """The pairs that cells give and plain comparison gives, whichever way a group goes; small groups aren't copied to cells."""
    rng = np.random.default_rng(3)
    rows = [(f"g{n}", k, "CNO"[int(rng.integers(3))], *map(float, rng.uniform(-4, 4, 3))) for n in (0, 1, 2, 7, 60) for k in range(n)]
    rows += [("g7", 7, "C", None, 0.0, 0.0), ("g7", 8, "C", float("nan"), 0.0, 0.0), (None, 0, "C", 0.0, 0.0, 0.0), (None, 1, "N", 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "struct_id string, atom_idx int, element string, x double, y double, z double")
    want = set()
    for s, i, e, *p in rows:
        for t, j, f, *q in rows:
            if s is not None and s == t and i < j and None not in (*p, *q) and (apart is None or e != f) and np.linalg.norm(np.subtract(p, q)) <= 1.9:
                want.add((s, i, j, e, f))
    for few in (0, 10, pairs.FEW):
        for ordered in (False, True):
            met = pairs.within(points, 1.9, 2.1, ordered=ordered, apart=apart, few=few)
            got = [(r.struct_id, r.i, r.j, r.element1, r.element2) for r in met.collect()]
            assert sorted(got) == sorted(want | {(s, j, i, f, e) for s, i, j, e, f in want} if ordered else want)
    assert len(want) > 20
    assert "Generate" not in pairs.within(points, 1.9, 2.1, apart=apart)._jdf.queryExecution().optimizedPlan().toString()
