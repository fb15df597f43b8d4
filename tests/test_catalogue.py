import pytest

from orbisect.plans import catalogue

from .compare import duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == duckdb_rows(catalogue.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["struct_id", "formula", "n_atoms", "mass", "com_x", "com_y", "com_z"]


def test_copies_have_no_displacement(spark, sf):
    assert {r.value for r in catalogue.rmsd_to_first(spark, sf).collect()} == {0.0}
