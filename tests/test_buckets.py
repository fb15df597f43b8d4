import json
import os
import random

import pytest
from pyspark.sql import functions as F

from orbisect.streaming import incremental
from orbisect.streaming.buckets import BucketTable

ROWS = "struct_id string, at int, v double"


def now(table, spark):
    return {r.struct_id: (r.at, r.v) for r in table.read(spark).collect()}


def test_upserts_as_a_dictionary(spark, tmp_path):
    r = random.Random(1)
    table, want = BucketTable(str(tmp_path / "t"), buckets=8), {}
    for n in range(4):
        rows = [(f"k{r.randrange(30)}", r.randrange(100), n + r.random()) for _ in range(12)]
        table.upsert(spark.createDataFrame(rows, ROWS).repartition(3), order="at")
        for k, at, v in rows:
            if k not in want or at > want[k][0]:
                want[k] = (at, v)
            elif at == want[k][0]:
                want[k] = None  # a tie, which the rows' contents decide
        got = now(table, spark)
        assert got.keys() == want.keys() and all(w is None or got[k] == w for k, w in want.items())
        want = got
    table.upsert(spark.createDataFrame([("k1", -5, 9.0), ("new", 1, 1.0)], ROWS))
    assert now(table, spark) == want | {"k1": (-5, 9.0), "new": (1, 1.0)}
    table.delete(spark.createDataFrame([("k1",), ("gone",)], "struct_id string"))
    assert now(table, spark) == {k: v for k, v in (want | {"new": (1, 1.0)}).items() if k != "k1"}
    assert table.vacuum() > 0 and table.vacuum() == 0 and len(now(table, spark)) == len(want | {"new": 0}) - ("k1" in want)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), buckets=32)
    first = table.upsert(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("struct_id"), F.lit(1).alias("at"), F.lit(0.0).alias("v")))
    before = table.read(spark)
    second = table.upsert(spark.createDataFrame([("k7", 2, 1.0), ("k7", 3, 2.0)], ROWS), order="at")
    changed = {b for b in first["folders"] if first["folders"][b] != second["folders"][b]}
    assert len(first["folders"]) == 32 and len(changed) == 1 and second["version"] == 2
    size = lambda name: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "t" / "data" / name) for f in fs)
    names = sorted(os.listdir(tmp_path / "t" / "data"))
    assert size(names[1]) < size(names[0]) / 10
    assert before.count() == 2000 and before.where("v > 0").count() == 0  # who opened the old version keeps it
    assert now(table, spark)["k7"] == (3, 2.0)


def test_a_failed_upsert_leaves_the_table(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    table.upsert(spark.createDataFrame([("a", 1, 1.0)], ROWS))
    with pytest.raises(Exception, match="no key"):
        table.upsert(spark.createDataFrame([("b", 1, 1.0), (None, 2, 2.0)], ROWS))
    assert now(table, spark) == {"a": (1, 1.0)}
    stale = table.manifest()
    table.upsert(spark.createDataFrame([("b", 1, 1.0)], ROWS))
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(stale | {"version": 2})
    table.upsert(spark.createDataFrame([], ROWS))
    assert now(table, spark) == {"a": (1, 1.0), "b": (1, 1.0)}


def test_streams(spark, tmp_path):
    """Batches are merged once, also after a restart; a fresh checkpoint goes on with the table that is there."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, **row):
        (folder / f"{name}.json").write_text(json.dumps(row))

    def go(check):
        stream = incremental.structure_stream(spark, str(folder), "struct_id string, energy double", 1)
        incremental.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / check)).awaitTermination()
        return {r.struct_id: r.energy for r in BucketTable(str(tmp_path / "table")).read(spark).collect()}

    put("a", struct_id="a", energy=1.0)
    put("b", struct_id="b", energy=2.0)
    assert go("c1") == {"a": 1.0, "b": 2.0} and go("c1") == {"a": 1.0, "b": 2.0}
    put("c", struct_id="a", energy=5.0)
    assert go("c1") == {"a": 5.0, "b": 2.0}
    for name in "abc":
        os.remove(folder / f"{name}.json")
    put("d", struct_id="d", energy=4.0)
    assert go("c2") == {"a": 5.0, "b": 2.0, "d": 4.0}
    table = BucketTable(str(tmp_path / "table"))
    version = table.manifest()["version"]
    assert table.upsert(spark.createDataFrame([("a", 0.0)], "struct_id string, energy double"), source="s", batch=3)["version"] == version + 1
    assert table.upsert(spark.createDataFrame([("a", 9.0)], "struct_id string, energy double"), source="s", batch=3)["version"] == version + 1
