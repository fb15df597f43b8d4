import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

from orbisect.operators.structures import STRUCTURE_SCHEMA
from orbisect.sources import datasource as D
from orbisect.sources import files


def made(spark, ids, parts=3):
    return spark.createDataFrame([(i, ["C", "O"], [[0.0, 0.0, k / 4], [1.0, 2.0, 3.0]], [], {"k": str(k)}) for k, i in enumerate(ids)], STRUCTURE_SCHEMA).repartition(parts)


def ids(df):
    return sorted(r.struct_id for r in df.collect())


@pytest.fixture
def source(spark):
    D.register(spark)
    return lambda at: spark.read.format("structures").load(at)


def test_append_and_overwrite(spark, source, tmp_path):
    at = str(tmp_path / "out")
    first, second = made(spark, ["a", "b/c", "d e%"]), made(spark, ["x", "é"])
    first.write.format("structures").mode("append").save(at)
    back = {r.struct_id: (r.elements, r.geometry, r.lattice, r.properties) for r in source(at).collect()}
    assert back == {r.struct_id: (r.elements, r.geometry, r.lattice, r.properties) for r in first.collect()}
    second.write.format("structures").mode("append").option("format", "xyz").save(at)
    assert len(ids(source(at))) == 5 and sorted(os.listdir(at)) == ["run-000000000001", "run-000000000002"]
    second.write.format("structures").mode("overwrite").save(at)
    assert ids(source(at)) == ["x", "é"] and os.listdir(at) == ["run-000000000003"]
    made(spark, ["q"]).limit(0).write.format("structures").mode("append").save(at)
    assert ids(source(at)) == ["x", "é"]


def test_a_failing_task_leaves_nothing(spark, source, tmp_path):
    at = str(tmp_path / "out")
    made(spark, ["a"]).write.format("structures").mode("append").save(at)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="without an id"):
            made(spark, ["b", "c", None], 1).write.format("structures").mode(mode).save(at)
        assert ids(source(at)) == ["a"] and os.listdir(at) == ["run-000000000001"]


def test_only_attempts_that_count_are_published(tmp_path):
    writer = D.StructureWriter({"path": str(tmp_path)}, ["struct_id"], False)
    for folder in ("00000000-1", "00000000-2"):
        (tmp_path / writer.staging / folder).mkdir(parents=True)
        (tmp_path / writer.staging / folder / "a.json").write_text(json.dumps({"struct_id": "a", "elements": [], "geometry": []}))
    assert D.StructureReader({"path": str(tmp_path), "recursive": "true"}).opened() == []  # nothing is seen before the commit
    writer.commit([D.Attempt("00000000-2", 1), None])
    assert [p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.json")] == ["run-000000000001/00000000-2/a.json"]


def test_filters_decide_which_files_are_opened(spark, source, tmp_path):
    at = str(tmp_path / "out")
    made(spark, [f"s{k}" for k in range(40)]).write.format("structures").mode("append").save(at)
    files.write(made(spark, ["loose"]), str(tmp_path / "l"))
    os.rename(tmp_path / "l" / "loose.json", tmp_path / "out" / "loose.json")

    def opened(*filters):
        reader = D.StructureReader({"path": at})
        left = list(reader.pushFilters(list(filters)))
        return len(reader.opened()), left

    more = GreaterThan(("struct_id",), "s")
    assert opened() == (41, []) and opened(more) == (41, [more])
    assert opened(EqualTo(("struct_id",), "s7"), more) == (2, [more])  # and the loose file, whose name isn't its id
    assert opened(In(("struct_id",), ("s1", "s2", "no"))) == (3, [])
    assert opened(StringEndsWith(("source_path",), "loose.json")) == (1, [])
    assert ids(source(at).where("struct_id = 's7'")) == ["s7"] and ids(source(at).where("struct_id IN ('s1', 'loose')")) == ["loose", "s1"]
    assert ids(source(at).where(F.col("source_path").endswith("loose.json"))) == ["loose"] and ids(source(at).where("struct_id LIKE 's3%' AND struct_id > 's35'")) == ["s36", "s37", "s38", "s39"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "s7" not in plan(source(at).where("struct_id = 's7'")) and "s7" in plan(source(at).where("struct_id > 's7'"))  # Spark keeps what isn't taken


def test_splits_are_packed(spark, source, tmp_path):
    at = str(tmp_path / "out")
    made(spark, [f"s{k}" for k in range(30)]).write.format("structures").mode("append").save(at)
    assert source(at).rdd.getNumPartitions() == 1
    many = D.packed(at, [(f"p{k:03d}", 100) for k in range(30)], most=10 * (D.OPEN + 100))
    assert [len(p.paths) for p in many] == [10, 10, 10] and [x for p in many for x in p.paths] == [f"p{k:03d}" for k in range(30)]
    assert [len(p.paths) for p in D.packed(at, [("a", 1), ("b", 10**9), ("c", 1)])] == [1, 1, 1] and D.packed(at, []) == []


def test_a_stream_goes_on_where_it_stopped(spark, source, tmp_path):
    at, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def turn():
        stream = spark.readStream.format("structures").load(at).select("struct_id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return ids(spark.read.schema("struct_id string").parquet(out))

    made(spark, ["a", "b"]).write.format("structures").mode("append").save(at)
    assert turn() == ["a", "b"] and turn() == ["a", "b"]
    made(spark, ["c"]).write.format("structures").mode("append").save(at)
    made(spark, ["d"]).write.format("structures").mode("append").save(at)
    assert turn() == ["a", "b", "c", "d"]
