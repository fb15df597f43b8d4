import json

from pyspark.sql import functions as F

from orbisect.operators import properties as P
from orbisect.operators.structures import STRUCTURE_SCHEMA

OPEN = {"e": -1.5, "d": {"a": [1, 2, {"b": None}]}, "ok": True, "n": 12345678901, "t": "text", "none": None, "s": "5"}


def docs(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "doc string")


def test_nested_round_trip(spark):
    doc = {"struct_id": "a", "elements": ["C"], "geometry": [[0.0, 0.5, 1.0]], "lattice": [], "properties": OPEN}
    once = P.from_typed_documents(docs(spark, doc))
    back = json.loads(P.typed_documents(once).first().doc)
    assert back == doc and isinstance(back["properties"]["ok"], bool) and isinstance(back["properties"]["s"], str)
    again = P.from_typed_documents(P.typed_documents(once).select("doc"))
    assert json.loads(P.typed_documents(again).first().doc) == doc
    got = {r.key: r.kind for r in P.kinds(once).collect()}
    assert got["e"].startswith("DECIMAL") and got["ok"] == "BOOLEAN" and got["n"] == "BIGINT" and got["t"] == "STRING" and got["d"].startswith("OBJECT")


def test_numbers_are_numbers(spark):
    rows = P.from_typed_documents(docs(spark, *({"struct_id": str(k), "elements": [], "geometry": [], "properties": {"e": e}} for k, e in enumerate([9, 10.5, "11", None, [12], -3]))))
    assert [r.struct_id for r in rows.where(P.value("e", "double") > 8).orderBy("struct_id").collect()] == ["0", "1", "2"]  # "11" reads as a number
    assert [r.e for r in P.typed_table(rows, {"e": "double"}).orderBy("struct_id").collect()] == [9.0, 10.5, 11.0, None, None, -3.0]
    deep = P.from_typed_documents(docs(spark, {"struct_id": "x", "d": {"a": [1, {"b": 7}]}}))
    assert deep.select(P.value("d", "int", "$.a[1].b")).first()[0] == 7 and deep.select(P.value("gone", "int")).first()[0] is None


def test_setting_and_odd_documents(spark):
    rows = spark.createDataFrame([("a", ["C"], [[0.0] * 3], [], {"old": "1", "text": "a b", "list": "[1]"}), ("b", [], [], [], None)], STRUCTURE_SCHEMA)
    new = P.with_typed(P.with_typed(P.with_typed(rows, "old", F.lit(2.5)), "many", F.array(F.lit(1), F.lit(2))), "made", F.struct(F.col("struct_id").alias("id")))
    got = {r.struct_id: json.loads(r.doc)["properties"] for r in P.typed_documents(new).collect()}
    assert got == {"a": {"old": 2.5, "text": "a b", "list": [1], "many": [1, 2], "made": {"id": "a"}}, "b": {"old": 2.5, "many": [1, 2], "made": {"id": "b"}}}
    odd = P.from_typed_documents(docs(spark, "{", "3", "null", {"elements": ["C"], "properties": {"k": 1}, "k": 2, "m": 3}), fallback_id=F.lit("f"))
    said = [(r.struct_id, json.loads(r.doc)) for r in P.typed_documents(odd).collect()]
    assert [x for x, _ in said] == ["f"] * 4 and [d["properties"] for _, d in said] == [{}, {}, {}, {"k": 1, "m": 3}]
    assert said[3][1]["elements"] == ["C"] and said[0][1]["elements"] is None
    assert P.typed_documents(P.from_typed_documents(docs(spark, "{").limit(0))).collect() == []
