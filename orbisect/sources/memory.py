"""Structures from objects in memory and back: arrays, pandas frames, and objects of other packages by their methods."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.structures import STRUCTURE_SCHEMA
from . import parsers


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Structures from dicts of struct_id, elements, geometry and, where there are, lattice and properties."""
    made = [parsers.row(r["struct_id"], r["elements"], r["geometry"], r.get("lattice") or (), r.get("properties")) for r in rows]
    names = ("struct_id", "elements", "geometry", "lattice", "properties")
    return spark.createDataFrame([tuple(r[k] for k in names) for r in made], STRUCTURE_SCHEMA)


def from_objects(spark: SparkSession, objects: dict[str, object]) -> DataFrame:
    """Structures from objects that have get_chemical_symbols(), get_positions() and get_cell(), or species, cart_coords and
    lattice.matrix; others raise."""
    rows = []
    for key, o in objects.items():
        if hasattr(o, "get_positions"):
            cell = [list(map(float, v)) for v in o.get_cell()] if any(getattr(o, "pbc", ())) else []
            rows.append({"struct_id": key, "elements": list(o.get_chemical_symbols()), "geometry": o.get_positions(), "lattice": cell})
        elif hasattr(o, "cart_coords"):
            cell = [list(map(float, v)) for v in o.lattice.matrix] if hasattr(o, "lattice") else []
            rows.append({"struct_id": key, "elements": [str(s) for s in o.species], "geometry": o.cart_coords, "lattice": cell})
        else:
            raise TypeError(f"{key} is a {type(o).__name__}, which has no known positions")
    return from_rows(spark, rows)


def to_pandas(structures: DataFrame) -> pd.DataFrame:
    """What the caller asked to have on the driver."""
    return structures.toPandas()
