import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisect.operators import crystals
from orbisect.operators.structures import STRUCTURE_SCHEMA
from orbisect.plans import drivers as D
from orbisect.sources import files

from .test_numerics import BENZENE, RING


@pytest.fixture(scope="module")
def rows(spark):
    lattice = np.diag([7.4, 9.5, 6.9])
    made = [("a", RING, BENZENE.tolist(), lattice.tolist(), {}), ("b", RING, ((BENZENE + [1.0, 2.0, 3.0]) % [7.4, 9.5, 6.9]).tolist(), lattice.tolist(), {}), ("c", RING, BENZENE.tolist(), (lattice * 1.2).tolist(), {})]
    return spark.createDataFrame(made, STRUCTURE_SCHEMA).cache()


def test_settings_come_back(tmp_path):
    for d in (D.PackingFactor(0.5), D.Supercell((1, 2, 3)), D.DuplicateCheck(), D.Motif(nn=5)):
        assert D.from_settings(d.settings()) == d
    D.checked_settings(D.PackingFactor(0.5), str(tmp_path / "s.json"))
    D.checked_settings(D.PackingFactor(0.5), str(tmp_path / "s.json"))
    assert D.read_settings(str(tmp_path / "s.json")) == D.PackingFactor(0.5)
    with pytest.raises(ValueError):
        D.checked_settings(D.PackingFactor(0.4), str(tmp_path / "s.json"))
    with pytest.raises(ValueError):
        D.from_settings({"driver": "Motif", "settings": {"other": 1}})
    with pytest.raises(KeyError):
        D.from_settings({"driver": "os.system", "settings": {}})


def test_drivers(rows):
    assert {r.struct_id: r.mol_idx for r in D.FindMolecules()(rows).groupBy("struct_id").agg(F.max("mol_idx").alias("mol_idx")).collect()} == {"a": 0, "b": 0, "c": 0}
    share = {r.struct_id: r.packing_factor for r in D.PackingFactor(0.5)(rows).collect()}
    assert 0 < share["c"] < share["a"] < 1 and abs(share["a"] - share["b"]) < 0.02
    assert D.Supercell((2, 1, 1))(rows).count() == 3 * 24
    assert D.SupercellSphere(8.0)(rows).count() > 36
    assert D.NeighborList(3.0)(rows).count() > D.NeighborList(mult=1.2)(rows).count() > 0
    assert {(r.id1, r.id2): r.value < 1e-6 for r in D.RMSD(6)(rows).collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}


def test_duplicates(rows):
    found = {(r.id1, r.id2): r.is_match for r in D.DuplicateCheck()(rows).collect()}
    assert found == {("a", "b"): True}
    assert D.DuplicateCheck(both=True)(rows).count() == 2
    assert {(r.leader, r.member) for r in crystals.unique(rows).collect()} == {("a", "a"), ("a", "b"), ("c", "c")}
    assert {(r.leader, r.member) for r in crystals.unique(rows, keep_single=False).collect()} == {("a", "a"), ("a", "b")}


def test_workflow(rows):
    flow = D.Workflow((D.Standardize(), D.PackingFactor(0.5)))
    assert flow.calc(rows).count() == 3
    assert D.Workflow.from_settings(flow.settings()) == flow


def test_folder_runs_go_on(spark, rows, tmp_path):
    files.write(rows.where("struct_id = 'a'"), str(tmp_path / "in"))
    run = D.FolderRun(D.PackingFactor(0.5), str(tmp_path / "in"), str(tmp_path / "out"))
    assert run.calc(spark).count() == 1
    files.write(rows, str(tmp_path / "in"), overwrite=True)
    assert run.calc(spark).count() == 3


@pytest.mark.parametrize("driver", [D.RMSD(6), D.DuplicateCheck()])
def test_pairwise_runs_go_on(spark, rows, tmp_path, driver):
    """The second run has the pairs of new structures with each other and with old ones, and none twice."""
    files.write(rows.where("struct_id <> 'b'"), str(tmp_path / "in"))
    run = D.FolderRun(driver, str(tmp_path / "in"), str(tmp_path / "out"))
    first = run.calc(spark).count()
    files.write(rows, str(tmp_path / "in"), overwrite=True)
    want = sorted((r.id1, r.id2) for r in driver(rows).collect())
    assert first < len(want) and sorted((r.id1, r.id2) for r in run.calc(spark).collect()) == want
    assert run.calc(spark).count() == len(want)
