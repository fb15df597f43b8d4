"""Per-structure and per-pair numerics over rows of arrays, in Arrow batches; no row leaves its task.

Rows hold whole structures (elements, geometry, lattice), so there is nothing to group: pairs come from a blocking join
(operators/pairs.py) that carries both structures' arrays, and equal formulas are its key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..session import spread


def applied(rows: DataFrame, fn: Callable[[dict], dict | list[dict]], schema: str, keep: tuple[str, ...] = ("struct_id",)) -> DataFrame:
    """fn over each row's dict; its result, one row or several, behind the columns `keep`. A row is long work, so rows are
    spread by `keep` first."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                found = fn(row)
                out += [{k: row[k] for k in keep} | f for f in (found if isinstance(found, list) else [found])]
            if out:
                yield pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return spread(rows, *keep).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), schema]))


def grid(value) -> np.ndarray:
    return np.array([list(v) for v in value], float)


def molecule(row: dict, n: str = "") -> tuple[np.ndarray, list[str]]:
    return grid(row[f"geometry{n}"]), list(row[f"elements{n}"])


def crystal(row: dict, n: str = "") -> tuple[np.ndarray, list[str], np.ndarray]:
    return *molecule(row, n), grid(row[f"lattice{n}"])


def principal_axes(structures: DataFrame) -> DataFrame:
    def fn(r: dict) -> dict:
        g, e = molecule(r)
        return {"axes": N.principal_axes(N.centred(g, e), e).tolist()}

    return applied(structures, fn, "axes array<array<double>>")


def aligned(structures: DataFrame) -> DataFrame:
    return applied(structures, lambda r: {"elements": molecule(r)[1], "geometry": N.aligned(*molecule(r)).tolist()}, "elements array<string>, geometry array<array<double>>")


def canonical(structures: DataFrame, mult: float = 1.2) -> DataFrame:
    """Structures with their atoms in canonical order, and `order`, where each was."""

    def fn(r: dict) -> dict:
        g, e = molecule(r)
        order = N.canonical_order(e, N.bond_lists(g, e, mult))
        return {"elements": [e[i] for i in order], "geometry": g[order].tolist(), "order": order}

    return applied(structures, fn, "elements array<string>, geometry array<array<double>>, order array<int>")


def symmetric_orders(structures: DataFrame, mult: float = 1.2) -> DataFrame:
    """A row for each graph-symmetric order of each molecule."""

    def fn(r: dict) -> list[dict]:
        g, e = molecule(r)
        return [{"order": o} for o in N.canonical_orders(e, N.bond_lists(g, e, mult))]

    return applied(structures, fn, "order array<int>")


def traversals(structures: DataFrame, mult: float = 1.2) -> DataFrame:
    return applied(structures, lambda r: {"path": N.traversal(molecule(r)[1], N.bond_lists(*molecule(r), mult))}, "path array<int>")


def symmetry(structures: DataFrame, max_rot: int = 4, tol: float = 0.1) -> DataFrame:
    """A row for each symmetry operation in the principal frame."""
    return applied(structures, lambda r: [{"op": op.tolist()} for op in N.symmetry(*molecule(r), max_rot, tol)], "op array<array<double>>")


def molecules_local(structures: DataFrame, mult: float = 1.2) -> DataFrame:
    """struct_id, mol_idx, atoms: components of molecules whose atoms fit in a row."""
    fn = lambda r: [{"mol_idx": k, "atoms": g} for k, g in enumerate(N.component_lists(N.bond_lists(*molecule(r), mult)))]
    return applied(structures, fn, "mol_idx int, atoms array<int>")


def whole(structures: DataFrame, mult: float = 1.2) -> DataFrame:
    """Crystals with molecules made whole: geometry, and molecules as lists of atoms."""

    def fn(r: dict) -> dict:
        geo, groups = N.whole_molecules(*crystal(r), mult)
        return {"elements": molecule(r)[1], "geometry": geo.tolist(), "lattice": grid(r["lattice"]).tolist(), "molecules": groups}

    return applied(structures, fn, "elements array<string>, geometry array<array<double>>, lattice array<array<double>>, molecules array<array<int>>")


def standardized(structures: DataFrame, mult: float = 1.2) -> DataFrame:
    def fn(r: dict) -> dict:
        geo, elements, groups = N.standardized(*crystal(r), mult)
        return {"elements": elements, "geometry": geo.tolist(), "lattice": grid(r["lattice"]).tolist(), "molecules": groups}

    return applied(structures, fn, "elements array<string>, geometry array<array<double>>, lattice array<array<double>>, molecules array<array<int>>")


def motifs(structures: DataFrame, nn: int = 32, tolerance: float = 10.0) -> DataFrame:
    return applied(structures, lambda r: N.motif(*crystal(r), nn, tolerance), "motif string, max_angle double, max_plane_angle double")


def packing(structures: DataFrame, spacing: float = 0.25) -> DataFrame:
    """struct_id, points, occupied, packing_factor, each structure in its row; generators.packing() gives the same for
    structures too large for that, as rows of points."""

    def fn(r: dict) -> dict:
        points, occupied = N.packing(*crystal(r), spacing)
        return {"points": points, "occupied": occupied, "packing_factor": occupied / points}

    return applied(structures, fn, "points long, occupied long, packing_factor double")


PAIR = ("id1", "id2")


def paired(pairs: DataFrame, structures: DataFrame) -> DataFrame:
    """Pairs (id1, id2) with both structures' arrays."""
    side = lambda n: structures.select(F.col("struct_id").alias(f"id{n}"), *(F.col(c).alias(f"{c}{n}") for c in ("elements", "geometry", "lattice") if c in structures.columns))
    return pairs.join(side(1), "id1").join(side(2), "id2")


def displacements(pairs: DataFrame) -> DataFrame:
    """id1, id2, value: mean displacement per atom after alignment, assignment, superposition and assignment."""
    return applied(pairs, lambda r: {"value": N.best_displacement(*molecule(r, "1"), *molecule(r, "2"))}, "value double", PAIR)


def grid_displacements(pairs: DataFrame, step: int = 36) -> DataFrame:
    return applied(pairs, lambda r: {"value": N.grid_displacement(*molecule(r, "1"), *molecule(r, "2"), step)}, "value double", PAIR)


def compared(pairs: DataFrame, tol: float = 0.15, chiral: bool = True) -> DataFrame:
    """id1, id2, is_match, rmsd, stage (where the cascade ended), mirrored."""
    return applied(pairs, lambda r: N.compare_molecules(*molecule(r, "1"), *molecule(r, "2"), tol, chiral), "is_match boolean, rmsd double, stage string, mirrored boolean", PAIR)


def crystal_rmsds(pairs: DataFrame, nn: int = 8, hydrogens: bool = False) -> DataFrame:
    return applied(pairs, lambda r: {"value": N.crystal_rmsd(crystal(r, "1"), crystal(r, "2"), nn, hydrogens)}, "value double", PAIR)


def clusters(structures: DataFrame, nn: int = 8, hydrogens: bool = False) -> DataFrame:
    """struct_id, first, first_sizes, others, others_sizes: what cluster_displacements() compares, computed once a structure;
    positions one after another, and how many each molecule has."""

    def fn(r: dict) -> dict:
        first, others = N.clusters(*crystal(r), nn, hydrogens)
        flat = lambda c: np.concatenate(c).ravel().tolist()
        return {"first": flat(first), "first_sizes": [len(m) for m in first], "others": [flat(c) for c in others], "others_sizes": [[len(m) for m in c] for c in others]}

    return applied(structures, fn, "first array<double>, first_sizes array<int>, others array<array<double>>, others_sizes array<array<int>>")


def cluster_displacements(pairs: DataFrame, limit: float = np.inf) -> DataFrame:
    """id1, id2, value of pairs with `first` of the one structure and `others` of the other; infinite where it isn't below the
    limit."""

    def fn(r: dict) -> dict:
        mols = lambda flat, sizes: np.split(np.asarray(flat, float).reshape(-1, 3), np.cumsum(sizes)[:-1])
        return {"value": N.clusters_apart(mols(r["first"], r["first_sizes"]), [mols(*c) for c in zip(r["others"], r["others_sizes"], strict=True)], limit)}

    return applied(pairs, fn, "value double", PAIR)


def dimer_parameters(dimers: DataFrame, mult: float = 1.2) -> DataFrame:
    """struct_id, rot1, rot2, trans of molecules of two components."""

    def fn(r: dict) -> dict:
        g, e = molecule(r)
        parts = N.component_lists(N.bond_lists(g, e, mult))
        if len(parts) != 2:
            raise ValueError(f"{r['struct_id']} has {len(parts)} molecules, not two")
        p = N.dimer_parameters(*((x) for k in parts for x in (g[k], [e[i] for i in k])))
        return {k: v.tolist() for k, v in p.items()}

    return applied(dimers, fn, "rot1 array<array<double>>, rot2 array<array<double>>, trans array<double>")


def matched_orders(pairs: DataFrame, mult: float = 1.2) -> DataFrame:
    """id1, id2, order: the second's atoms in the order of the first's; null where their graphs differ."""

    def fn(r: dict) -> dict:
        (a, ea), (b, eb) = molecule(r, "1"), molecule(r, "2")
        return {"order": N.matched_order(ea, N.bond_lists(a, ea, mult), eb, N.bond_lists(b, eb, mult))}

    return applied(pairs, fn, "order array<int>", PAIR)


def rotations(structures: DataFrame, max_rot: int = 4, tol: float = 0.1) -> DataFrame:
    """struct_id and `ops`: the rotations of a molecule in its principal frame that leave it as it is, as quaternions."""
    fn = lambda r: {"ops": [N.quaternion(op) for op in N.rotation_symmetry(*molecule(r), max_rot, tol)]}
    return applied(structures, fn, "ops array<array<double>>")


def residues(structures: DataFrame, n: int) -> DataFrame:
    """struct_id, mult, molecules: each structure parted into n kinds of molecules by the first multiplier that does it."""

    def fn(r: dict) -> dict:
        mult, parts = N.residues(*molecule(r), n)
        return {"mult": mult, "molecules": parts}

    return applied(structures, fn, "mult double, molecules array<array<int>>")


def parameters(structures: DataFrame) -> DataFrame:
    """struct_id, coms, orientations of crystals of one kind of molecule."""

    def fn(r: dict) -> dict:
        p = N.crystal_parameters(*crystal(r))
        return {"coms": [c.tolist() for c in p["coms"]], "orientations": [o.tolist() for o in p["orientations"]]}

    return applied(structures, fn, "coms array<array<double>>, orientations array<array<array<double>>>")
