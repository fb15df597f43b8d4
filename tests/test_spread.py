"""Small rows that are long work: all cores take part, and no work is done twice."""

from itertools import product

import numpy as np

from orbisect.functions import numerics as N
from orbisect.functions.elements import VDW
from orbisect.functions.geometry import euler_matrix
from orbisect.operators import crystals, generators, local, pairs
from orbisect.plans import chains, samples


def test_symmetry_turns_each_molecule_once_on_all_cores(spark, sf):
    rows = samples.supplier_molecules(spark, sf).coalesce(1)
    assert local.symmetry(rows, 4, 0.3).rdd.getNumPartitions() > 1
    for atoms in samples.MOLECULES.values():
        e, g = [a[0] for a in atoms], np.array([a[1:] for a in atoms], float)
        base = N.aligned(g, e)
        ops = [np.array(euler_matrix(*x)) for x in product(range(0, 360, 90), repeat=3)]
        plain = {tuple(np.round(op, 4).ravel() + 0.0) for op in ops if N.element_displacement(base, e, base @ op.T, e) < 0.3}
        assert sorted(tuple(op.ravel()) for op in N.rotation_symmetry(g, e, 4, 0.3)) == sorted(plain)
    assert len(N.rotation_grid(90)) == 24


def test_equal_crystals_are_not_tried_on(monkeypatch):
    """The first start that superposes clusters but for rounding ends the search."""
    calls, plain = [], N.cluster_displacement
    monkeypatch.setattr(N, "cluster_displacement", lambda *a, **k: calls.append(1) or plain(*a, **k))
    e, g = (list(x) for x in zip(*((a[0], a[1:]) for a in samples.MOLECULES["methanol"]), strict=True))
    cell = np.eye(3) * 7.0
    assert N.crystal_rmsd((np.array(g), e, cell), (np.array(g) + [1.3, -0.7, 2.9], e, cell), 8, True) < 1e-9
    assert len(calls) <= 2


def test_copies_of_a_crystal_are_compared_once(spark, sf, monkeypatch):
    """Copies add pairs, not comparisons; which of two is new counts for each copy."""
    from pyspark.sql import functions as F

    rows = chains.box_crystals(spark, sf).where("struct_id < 's00000003'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    rows = rows.withColumns({"struct_id": F.concat_ws("-", "struct_id", F.format_string("%02d", "copy")), "is_new": F.col("copy") == 7}).drop("copy")
    seen, plain = [], local.cluster_displacements
    monkeypatch.setattr(local, "cluster_displacements", lambda df, limit: seen.append(df.count()) or plain(df, limit))
    found = crystals.duplicates(rows, strain=0.03, rmsd=0.1).where("is_match").collect()
    ids = [f"s{k:08d}-{c:02d}" for k in range(3) for c in range(1, 21)]
    assert sorted((x.id1, x.id2) for x in found) == [(a, b) for a in ids for b in ids if a < b and a[:9] == b[:9] and "07" in (a[-2:], b[-2:])]
    assert seen and seen[0] <= 9


def test_atoms_at_one_place_are_checked_once(spark):
    """Copies change no least ratio, and aren't met; pairs are dealt over several tasks."""
    rows = [("a", k, "HO" if k % 2 else "ON", "H" if k % 2 else "O", float(k % 3), 0.5, 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "struct_id string, atom_idx int, neighbourhood string, element string, x double, y double, z double").coalesce(1)
    moved = df.withColumn("y", df.y + 1)
    one, every = pairs.cutoffs(pairs.places(df), pairs.places(moved)), pairs.cutoffs(df, moved)
    assert one.count() == 36 and every.count() == 90000 and every.rdd.getNumPartitions() > 1
    assert pairs.distance_check(one, 0.1, 1).collect() == pairs.distance_check(every, 0.1, 1).collect()


def test_ways_of_many_bonds_are_followed_as_bits(spark, monkeypatch):
    """Dense and sparse structures, in several blocks and strips, against a plain walk; bonds from one end alone as well."""
    monkeypatch.setattr(pairs, "SOURCES", 16)
    monkeypatch.setattr(pairs, "BITS", 1000)
    r = np.random.default_rng(3)
    links = {("dense", int(a), int(b)) for a, b in r.integers(0, 60, (500, 2)) if a != b} | {("chain", k, k + 1) for k in range(40)} | {("chain", k + 1, k) for k in range(40)}
    found = pairs.within_bonds(spark.createDataFrame(sorted(links), "struct_id string, i int, j int"), 3).collect()
    near = {}
    for s, a, b in links:
        near.setdefault((s, a), set()).add(b)
    want = set()
    for s, a in near:
        seen = {a}
        for _ in range(3):
            seen |= {y for x in seen for y in near.get((s, x), ())}
        want |= {(s, a, b) for b in seen - {a}}
    assert sorted(map(tuple, found)) == sorted(want)
    rows, cols = np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4])
    assert [x.tolist() for x in pairs.reached(rows, cols, 5, np.array([0, 3]), 3)] == [[1, 2, 3], [4]]


def test_orientations_are_found_once_for_equal_rotations(spark):
    """Structures of the same rotations, or without any, share one search; each has its own rows."""
    one, two = [[1.0, 0.0, 0.0, 0.0]], [[1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(f"s{k}", (None, one, two)[k % 3]) for k in range(9)], "struct_id string, ops array<array<double>>")
    got = generators.unique_angles(df, 90)
    sizes = {r.struct_id: r["count"] for r in got.groupBy("struct_id").count().collect()}
    assert sizes == {f"s{k}": (24, 24, 12)[k % 3] for k in range(9)}
    alike = {r.a for r in got.where("struct_id IN ('s2', 's5', 's8')").groupBy("a", "b", "c").count().select(pairs.F.col("count").alias("a")).collect()}
    assert alike == {3}


def test_rows_of_one_value_meet_in_several_tasks(spark):
    df = spark.range(200).selectExpr("id", "1 AS g", "id * 2 AS v").coalesce(1)
    found = pairs.unordered(df, "id", ["g"], ["v"])
    assert sorted((r.id1, r.id2, r.v1, r.v2) for r in found.collect()) == [(a, b, 2 * a, 2 * b) for a in range(200) for b in range(a + 1, 200)]
    assert found.groupBy(pairs.F.spark_partition_id()).count().count() > 1


def test_cutoffs_are_found_once_a_place_and_whole_in_any_parts(spark, monkeypatch):
    """All pairs of a large and a small structure, dealt in many parts and lists or in one, from few rows of places."""
    kinds, r = ("HO", "HN", "ON", "NC", "CH"), np.random.default_rng(9)
    rows = lambda sizes: [(s, k, kinds[k % 5], kinds[k % 5][0], float(r.integers(3)), 0.0, float(k % 2)) for s, n in sizes for k in range(n)]
    a, b = rows((("big", 200), ("small", 3), ("alone", 2))), rows((("big", 90), ("small", 2), ("other", 4)))
    of = "struct_id string, atom_idx int, neighbourhood string, element string, x double, y double, z double"
    first, second = spark.createDataFrame(a, of), spark.createDataFrame(b, of)

    def cutoff(n, m):
        for h, o in ((n, m), (m, n)):
            if h in ("HO", "HN") and o[0] in "NO":
                return pairs.HYDROGEN_BONDS[h[1], o[0]]
        return VDW[n[0]] + VDW[m[0]]

    want = sorted((s, i, j, round(cutoff(n, m), 9), round(float(np.linalg.norm(np.subtract(p, q))), 9)) for s, i, n, _, *p in a for t, j, m, _, *q in b if s == t)
    for met, part in ((pairs.MET, pairs.PART), (500, 20)):
        monkeypatch.setattr(pairs, "MET", met)
        monkeypatch.setattr(pairs, "PART", part)
        found = pairs.cutoffs(first, second)
        assert sorted((x.struct_id, x.i, x.j, round(x.cutoff, 9), round(x.d, 9)) for x in found.collect()) == want
        if part > 20:
            assert pairs.place_cutoffs(first, second).where("struct_id = 'big'").count() <= 30 * 30 < 200 * 90 / 10
    assert found.columns == ["struct_id", "i", "element1", "neighbourhood1", "x1", "y1", "z1", "j", "element2", "neighbourhood2", "x2", "y2", "z2", "cutoff", "d"]
