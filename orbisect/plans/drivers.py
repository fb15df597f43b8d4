"""Operators as configured objects: settings that can be written down, checked and rebuilt, and chains of them.

A driver is a frozen dataclass that maps a frame to a frame. Its settings are its fields under its class's name; they
are rebuilt from a registry of the classes here, never by importing what a file names.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crystals, generators, local, networks, pairs, structures
from ..sources import files
from ..streaming import incremental

REGISTRY: dict[str, type] = {}


@dataclass(frozen=True)
class Driver:
    """Structures in, a frame out."""

    def __init_subclass__(cls) -> None:
        REGISTRY[cls.__name__] = cls

    def calc(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.calc(rows)

    def settings(self) -> dict:
        return {"driver": type(self).__name__, "settings": asdict(self)}


def from_settings(settings: dict) -> Driver:
    cls = REGISTRY[settings["driver"]]
    known = {f.name for f in fields(cls)}
    if more := set(settings["settings"]) - known:
        raise ValueError(f"{cls.__name__} has no {sorted(more)}")
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings["settings"].items()})


def checked_settings(driver: Driver, path: str) -> None:
    """Write a driver's settings to a file once; later runs must have the same."""
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    now = json.loads(json.dumps(driver.settings()))
    if fs.get_file_info(inner).type == pafs.FileType.File:
        with fs.open_input_stream(inner) as f:
            before = json.loads(f.read())
        if before != now:
            raise ValueError(f"{path} holds other settings: {before}")
        return
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as f:
        f.write(json.dumps(now).encode())


def read_settings(path: str) -> Driver:
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(inner) as f:
        return from_settings(json.loads(f.read()))


def lattices_of(rows: DataFrame) -> DataFrame:
    return rows.select("struct_id", "lattice").where(~structures.is_molecule())


@dataclass(frozen=True)
class PackingFactor(Driver):
    spacing: float = 0.25

    def calc(self, rows: DataFrame) -> DataFrame:
        return local.packing(rows, self.spacing)


@dataclass(frozen=True)
class Motif(Driver):
    nn: int = 32
    sheet_angle_tolerance: float = 10.0

    def calc(self, rows: DataFrame) -> DataFrame:
        return local.motifs(rows, self.nn, self.sheet_angle_tolerance)


@dataclass(frozen=True)
class Standardize(Driver):
    mult: float = 1.2

    def calc(self, rows: DataFrame) -> DataFrame:
        out = local.standardized(rows, self.mult).drop("molecules")
        return out.withColumn("properties", F.create_map().cast("map<string,string>"))


@dataclass(frozen=True)
class FindMolecules(Driver):
    """mol_idx of each atom of molecules or crystals, the cell that its whole molecule takes it from, and along how many
    directions the molecule is endless."""

    mult: float = 1.05

    def calc(self, rows: DataFrame) -> DataFrame:
        atoms = structures.to_atoms(rows)
        found = pairs.periodic_bonds(atoms.join(lattices_of(rows), "struct_id", "left_semi"), lattices_of(rows), self.mult).drop("d")
        alone = pairs.bond_trees(atoms.join(lattices_of(rows), "struct_id", "left_anti"), self.mult)
        alone = alone.select("struct_id", "i", "j", *(F.lit(0).alias(c) for c in networks.CELL))
        return networks.molecules(atoms, found.unionByName(alone))


@dataclass(frozen=True)
class Supercell(Driver):
    mult: tuple[int, int, int] = (3, 3, 3)

    def calc(self, rows: DataFrame) -> DataFrame:
        return generators.supercell(structures.to_atoms(rows), lattices_of(rows), self.mult)


@dataclass(frozen=True)
class SupercellSphere(Driver):
    radius: float = 10.0
    mult: int = 0
    correction: bool = True

    def calc(self, rows: DataFrame) -> DataFrame:
        return generators.sphere(structures.to_atoms(rows), lattices_of(rows), self.radius, self.mult, self.correction)


@dataclass(frozen=True)
class NeighborList(Driver):
    """Neighbours within a radius, or within mult times the covalent radii where no radius is given."""

    cutoff_radius: float = 8.0
    mult: float = 0.0

    def calc(self, rows: DataFrame) -> DataFrame:
        atoms, lats = structures.to_atoms(rows), lattices_of(rows)
        if self.mult:
            return pairs.periodic_bonds(atoms, lats, self.mult)
        return pairs.periodic_neighbours(atoms, lats, self.cutoff_radius, self.cutoff_radius)


@dataclass(frozen=True)
class DuplicateCheck(Driver):
    """Scored pairs of crystals whose lattices are within a strain; `both` lists each from either side."""

    strain: float = 0.1
    rmsd: float = 0.5
    both: bool = False

    def calc(self, rows: DataFrame) -> DataFrame:
        found = crystals.duplicates(rows, self.strain, self.rmsd)
        return pairs.both_sides(found) if self.both else found


@dataclass(frozen=True)
class RMSD(Driver):
    """Cluster displacement of all pairs of one formula."""

    nn: int = 8
    hydrogens: bool = False

    def calc(self, rows: DataFrame) -> DataFrame:
        some = ["is_new"] if "is_new" in rows.columns else []
        key = rows.select("struct_id", F.array_join(F.array_sort("elements"), "").alias("formula"), *some)
        met = pairs.unordered(key, "struct_id", ["formula"], some)
        met = (met.where("is_new1 OR is_new2") if some else met).select("id1", "id2")
        return local.crystal_rmsds(local.paired(met, rows), self.nn, self.hydrogens)


#: Drivers whose rows are pairs of structures.
PAIRWISE = (DuplicateCheck, RMSD)


@dataclass(frozen=True)
class Workflow:
    """Drivers one after another, each on what the one before returns."""

    drivers: tuple[Driver, ...]

    def calc(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, d: df.transform(d.calc), self.drivers, rows)

    def settings(self) -> list[dict]:
        return [d.settings() for d in self.drivers]

    @staticmethod
    def from_settings(settings: list[dict]) -> Workflow:
        return Workflow(tuple(from_settings(s) for s in settings))


@dataclass(frozen=True)
class FolderRun:
    """A driver over a folder of structure files into a Parquet folder; a run that broke off goes on where it stopped. A driver
    of pairs compares new structures with each other and with the old ones."""

    driver: Driver
    source: str
    output: str
    file_format: str = ""

    def calc(self, spark: SparkSession) -> DataFrame:
        rows = files.read_dictionary(spark, self.source, self.file_format).drop("source_path")
        checked_settings(self.driver, f"{self.output.rstrip('/')}-settings.json")
        run = incremental.run_remaining_pairs if isinstance(self.driver, PAIRWISE) else incremental.run_remaining
        return run(rows, self.output, self.driver.calc)
