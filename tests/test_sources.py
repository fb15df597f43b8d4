import json
import math

import pytest

from orbisect.operators import structures
from orbisect.sources import datasource, files, parsers

XYZ = "3\nwater\nO 0.0 0.0 0.0\nh 0.757 0.586 0.0\nH -0.757 0.586 0.0\n"
GEOMETRY = "# a cell\nlattice_vector 4 0 0\nlattice_vector 0 5 0\nlattice_vector 0 0 6\natom 0.1 0.2 0.3 C\natom_frac 0.5 0.5 0.5 O\n"
CIF = """data_x
_cell_length_a 4.0(1)
_cell_length_b 5.0
_cell_length_c 6.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_chemical_name 'a name'
loop_
_symmetry_equiv_pos_as_xyz
x,y,z
-x,-y,-z
1/2+x,1/2-y,-z
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
C1 C 0.1 0.2 0.3
C1b C 1.1 0.2 0.3
O1 O 0.0 0.0 0.0
"""


def test_xyz_frames_and_line_ends():
    one = parsers.parse_xyz(XYZ, "w")
    assert [r["struct_id"] for r in one] == ["w_0"] and one[0]["elements"] == ["O", "H", "H"]
    two = parsers.parse_xyz((XYZ + XYZ).replace("\n", "\r\n") + "\r\n", "w")
    assert [r["struct_id"] for r in two] == ["w_0", "w_1"]


def test_geometry():
    r = parsers.parse_geometry(GEOMETRY, "g")[0]
    assert r["geometry"][1] == [2.0, 2.5, 3.0] and len(r["lattice"]) == 3


def test_cif_expands_and_merges():
    r = parsers.parse_cif(CIF.replace("\n", "\r"), "c")[0]
    assert sorted(r["elements"]) == ["C"] * 3 + ["O"] * 2
    assert r["properties"] == {"_chemical_name": "a name"}
    assert math.isclose(r["lattice"][2][2], 6.0)


def test_operations():
    m, s = parsers.operation("-x+1/2, y-z, 0.25+z")
    assert m.tolist() == [[-1, 0, 0], [0, 1, -1], [0, 0, 1]] and s.tolist() == [0.5, 0.0, 0.25]


def test_json_forms():
    doc = {"struct_id": "a", "geometry": [[0, 0, 0]], "elements": ["C"], "lattice": [], "properties": {"e": 1}, "more": 2}
    assert parsers.parse_json(json.dumps(doc), "f")[0]["properties"] == {"e": "1", "more": "2"}
    assert [r["struct_id"] for r in parsers.parse_json(json.dumps({"p": {k: v for k, v in doc.items() if k != "struct_id"}}), "f")] == ["p"]
    assert parsers.parse_json(json.dumps({"geometry": [], "elements": []}), "f")[0]["struct_id"] == "f"


def test_names():
    assert parsers.file_type("/a/b.cif") == "cif" and parsers.file_type("/a/.hidden") == "" and parsers.file_type("a.next_step") == "geometry"
    assert parsers.with_extension("a.json", "cif") == "a.cif" and parsers.with_extension("a.b", "cif") == "a.b.cif"
    with pytest.raises(ValueError):
        parsers.checked_format("png")


def put(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / "w.xyz").write_text(XYZ)
    (folder / "g.in").write_text(GEOMETRY)
    (folder / "broken.json").write_text("{")
    (folder / ".hidden.xyz").write_text(XYZ)
    (folder / "sub" / "c.cif").write_text(CIF)
    (folder / "sub" / "note.txt").write_text("no structure")


def test_folders(spark, tmp_path):
    put(tmp_path / "in")
    at = str(tmp_path / "in")
    assert sorted(r.struct_id for r in files.read(spark, at).collect()) == ["g", "w_0"]
    assert sorted(r.struct_id for r in files.read(spark, at, recursive=True).collect()) == ["c", "g", "w_0"]
    assert [r.struct_id for r in files.read(spark, at, recursive=True, folder_names=["sub"], path_ids=True).collect()] == ["sub_c"]
    assert files.has_structures(spark, at)
    datasource.register(spark)
    assert sorted(r.struct_id for r in spark.read.format("structures").option("recursive", "true").load(at).collect()) == ["c", "g", "w_0"]


@pytest.mark.parametrize("kind", ["json", "xyz", "geometry", "cif"])
def test_round_trips(spark, tmp_path, kind):
    put(tmp_path / "in")
    rows = files.read(spark, str(tmp_path / "in"), recursive=True).drop("source_path")
    rows = rows.where("size(lattice) = 3") if kind == "cif" else rows
    files.write(rows, str(tmp_path / "out"), kind)
    with pytest.raises(FileExistsError):
        files.write(rows, str(tmp_path / "out"), kind)
    back = files.read_dictionary(spark, str(tmp_path / "out"))
    count = lambda df: sorted((r.struct_id.split("_")[0], sorted(r.elements)) for r in df.collect())
    assert count(back) == count(rows)
    if kind == "json":
        near = {r.struct_id: r.geometry for r in back.collect()}
        assert near == {r.struct_id: r.geometry for r in rows.collect()}


def test_combined_and_many_formats(spark, tmp_path):
    put(tmp_path / "in")
    rows = files.read(spark, str(tmp_path / "in")).drop("source_path")
    files.write(rows, str(tmp_path / "all"), combined=True)
    assert structures.from_documents(spark.read.text(str(tmp_path / "all")).withColumnRenamed("value", "doc")).count() == 2
    files.write_formats(rows, str(tmp_path / "many"), ("json", "xyz"))
    assert {p.name for p in (tmp_path / "many").iterdir()} == {"json", "xyz"}
