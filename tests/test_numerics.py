from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbisect.functions import numerics as N
from orbisect.functions.geometry import euler_matrix

A = np.radians(np.arange(6) * 60)
BENZENE = np.vstack([np.c_[1.39 * np.cos(A), 1.39 * np.sin(A), 0 * A], np.c_[2.48 * np.cos(A), 2.48 * np.sin(A), 0 * A]])
RING = ["C"] * 6 + ["H"] * 6


def turned(geo, elements, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.permutation(len(elements))
    r = np.array(euler_matrix(*rng.integers(0, 360, 3)))
    return (geo @ r.T + rng.random(3) * 5)[p], [elements[i] for i in p]


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_the_cheapest(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m))
    i, j = N.assignment(cost)
    small, large = min(n, m), max(n, m)
    best = min(sum(cost[a, p[a]] if n <= m else cost[p[a], a] for a in range(small)) for p in permutations(range(large), small))
    assert len(set(i)) == len(set(j)) == small
    assert cost[i, j].sum() == pytest.approx(best)


def test_superposition_finds_the_rotation():
    rot = np.array(euler_matrix(10, 20, 30))
    geo = np.random.default_rng(1).random((7, 3))
    assert np.allclose(N.superposition(geo @ rot.T, geo), rot)


def test_benzene_has_twelve_orders():
    assert len(N.canonical_orders(RING, N.bond_lists(BENZENE, RING))) == 12


@pytest.mark.parametrize("seed", range(5))
def test_order_frame_and_displacement_dont_depend_on_the_pose(seed):
    geo, elements = turned(BENZENE, RING, seed)
    assert N.best_displacement(BENZENE, RING, geo, elements) < 1e-6
    found = N.compare_molecules(BENZENE, RING, geo, elements)
    assert found["is_match"] and found["rmsd"] < 1e-6
    code = lambda g, e: [e[i] for i in N.canonical_order(e, N.bond_lists(g, e))]
    assert code(geo, elements) == code(BENZENE, RING)


def test_compare_stops_at_the_first_difference():
    assert N.compare_molecules(BENZENE, RING, BENZENE[:6], RING[:6])["stage"] == "formula"
    apart = BENZENE.copy()
    apart[0] += 9
    assert N.compare_molecules(BENZENE, RING, apart, RING)["stage"] == "graph"


def test_mirror_images_match_only_if_not_chiral():
    geo = np.array([[0, 0, 0], [1.0, 0.3, 0.4], [-0.9, 0.5, 0.2], [0.1, -1.0, 0.6], [0.2, 0.1, -1.1]])
    elements = ["C", "H", "F", "O", "N"]
    mirror = geo * [1, 1, -1]
    assert not N.compare_molecules(geo, elements, mirror, elements, tol=0.05)["is_match"]
    assert N.compare_molecules(geo, elements, mirror, elements, tol=0.05, chiral=False)["is_match"]


def test_three_measures_differ():
    a, b = np.zeros((4, 3)), np.ones((4, 3)) * [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]]
    assert N.mean_displacement(a, b) == pytest.approx((3 + 3**0.5) / 4)
    assert N.mean_displacement_per_atom(a, b) == pytest.approx((3 + 3**0.5) / 16)
    assert N.rms(a, b) == pytest.approx(1.5**0.5)


def test_whole_molecules_rejoin_what_the_cell_cuts():
    lattice = np.eye(3) * 8.0
    cut = (BENZENE + [0.2, 0.1, 7.9]) % 8.0
    geo, groups = N.whole_molecules(cut, RING, lattice)
    assert groups == [list(range(12))]
    assert len(N.component_lists(N.bond_lists(cut, RING))) > 1
    assert len(N.component_lists(N.bond_lists(geo, RING))) == 1


def test_crystal_rmsd_of_a_moved_crystal_is_zero():
    lattice = np.eye(3) * 9.0
    assert N.crystal_rmsd((BENZENE, RING, lattice), (BENZENE + [1.0, 2.0, 3.0], RING, lattice), 6, True) < 1e-6


def test_symmetry_of_water():
    geo = np.array([[0, 0, 0], [0.757, 0.586, 0], [-0.757, 0.586, 0]])
    ops = N.symmetry(geo, ["O", "H", "H"], 4, 0.1)
    assert len(ops) == 4 and all(abs(abs(np.linalg.det(o)) - 1) < 1e-3 for o in ops)
    turns = N.rotation_symmetry(geo, ["O", "H", "H"], 4, 0.1)
    for op in turns:
        w, x, y, z = N.quaternion(op)
        back = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
        assert w >= 0 and np.abs(np.array(back) - op).max() < 1e-6


def test_dimer_round_trip():
    p = N.dimer_parameters(BENZENE, RING, BENZENE + [0, 0, 4], RING)
    made = N.dimer(p["rot1"], p["rot2"], p["trans"], BENZENE, RING, BENZENE, RING)
    assert N.matched_displacement(made, np.vstack([BENZENE, BENZENE + [0, 0, 4]])) < 1e-6
    far = N.offset_dimer(made, RING * 2, [list(range(12)), list(range(12, 24))], 6.0, relative=False)
    assert np.linalg.norm(far[12:].mean(0) - far[:12].mean(0)) == pytest.approx(6.0, abs=1e-6)


def test_motifs():
    lattice = np.diag([4.0, 9.0, 9.0])
    flat = BENZENE[:, [2, 0, 1]]
    assert N.motif(flat, RING, lattice, nn=8)["motif"] == "sheet"
    tilted = np.vstack([flat, flat @ np.array(euler_matrix(0, 50, 0)).T + [0, 9.0, 0]])
    assert N.motif(tilted, RING * 2, np.diag([6.0, 18.0, 9.0]), nn=8)["motif"] == "gamma"
