"""Open properties that keep their types: map<string,variant> in place of map<string,string>.

A property is a JSON value of any shape. It stays one from document to document: numbers are compared as numbers, and
lists and objects can be looked into by paths, without a schema that all structures share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPED = "map<string,variant>"
FIELDS = ("struct_id", "elements", "geometry", "lattice", "properties")


def typed(structures: DataFrame) -> DataFrame:
    """structures with text properties read as JSON; what isn't JSON is a text. Null properties are none."""
    if structures.schema["properties"].dataType.simpleString() == TYPED:
        return structures
    value = lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant"))
    return structures.withColumn("properties", F.coalesce(F.transform_values("properties", value), none()))


def none() -> Column:
    return F.create_map().cast(TYPED)


def with_typed(structures: DataFrame, key: str, value: Column) -> DataFrame:
    """structures with a typed property set; value: a number, text, truth value, list, struct or map."""
    rows = typed(structures).withColumn("__v", value)
    kind = rows.schema["__v"].dataType.simpleString()
    made = F.to_variant_object("__v") if kind.startswith(("array<", "struct<", "map<")) else F.col("__v").cast("variant")
    old = F.map_filter("properties", lambda k, _: k != key)
    return rows.withColumn("properties", F.map_concat(old, F.map_from_arrays(F.array(F.lit(key)), F.array(made)))).drop("__v")


def value(key: str, kind: str, path: str = "$") -> Column:
    """A property, or what a path in it leads to, as a type; null where a structure lacks it or it is something else."""
    return F.try_variant_get(F.try_element_at("properties", F.lit(key)), path, kind)


def typed_table(structures: DataFrame, keys: dict[str, str]) -> DataFrame:
    """struct_id and a column for each key, of the type that keys gives it."""
    return typed(structures).select("struct_id", *(value(k, kind).alias(k) for k, kind in keys.items()))


def kinds(structures: DataFrame) -> DataFrame:
    """key, kind, n: which types the properties have, and in how many structures."""
    each = typed(structures).select(F.explode("properties").alias("key", "v"))
    return each.groupBy("key", F.schema_of_variant("v").alias("kind")).agg(F.count("*").alias("n"))


def typed_documents(structures: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """struct_id and `doc`: JSON of the fields, properties as the values that they are."""
    return typed(structures).select("struct_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("doc"))


def from_typed_documents(docs: DataFrame, column: str = "doc", fallback_id: Column | None = None) -> DataFrame:
    """Structures with typed properties from JSON; unknown keys at the top join the properties, which stand where both have
    one, and a missing id is taken from `fallback_id`. What isn't a JSON object gives a row of nulls without properties."""
    v = F.try_parse_json(column)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    own = F.coalesce(get("$.properties", TYPED), none())
    more = F.map_filter(F.coalesce(get("$", TYPED), none()), lambda k, _: ~k.isin(*FIELDS) & ~F.map_contains_key(own, k))
    empty = F.array().cast("array<array<double>>")
    return docs.select(
        F.coalesce(get("$.struct_id", "string"), F.lit(None).cast("string") if fallback_id is None else fallback_id).alias("struct_id"), get("$.elements", "array<string>").alias("elements"),
        get("$.geometry", "array<array<double>>").alias("geometry"), F.coalesce(get("$.lattice", "array<array<double>>"), empty).alias("lattice"), F.map_concat(own, more).alias("properties"),
    )
