import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundframe.operators import geology, mesh
from groundframe.sources import boreholes, kind_of, models, splits, surfaces

TETRA = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 1, 0), (0, 0, 1)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]


def test_borehole_csv_by_depth(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        "\ufeffborehole_id,x,y,ground_level,top_depth,bottom_depth,layer_id,soil_type,remark\n"
        "P-1,3,5,40.5,0,1.5,made ground,M1,topsoil\nP-1,3,5,40.5,1.5,7,marl,M2,stiff\nP-2,23,5,39,0,2,made ground,M1,\n,33,9,38,0,4,marl,,\n"
    )
    holes, layers = boreholes.read_boreholes(spark, str(tmp_path / "b.csv"))
    assert {r["borehole_id"]: (r["x"], r["z"]) for r in holes.collect()} == {"p_1": (3.0, 40.5), "p_2": (23.0, 39.0), "bh_4": (33.0, 38.0)}
    got = {(r["borehole_id"], r["seq"]): (r["layer_id"], r["material_id"], r["top"], r["bottom"]) for r in layers.collect()}
    assert got == {("p_1", 1): ("made_ground", "m1", 40.5, 39.0), ("p_1", 2): ("marl", "m2", 39.0, 33.5), ("p_2", 1): ("made_ground", "m1", 39.0, 37.0), ("bh_4", 1): ("marl", "marl", 38.0, 34.0)}
    points = boreholes.control_points(holes, layers)
    assert points.where("surface = 'layer_marl_bottom'").count() == 2
    box = boreholes.extent(points).first()
    assert (box["x0"], box["x1"], box["y0"], box["y1"], box["z0"], box["z1"]) == (3.0, 33.0, 5.0, 9.0, 33.5, 40.5)


def test_borehole_csv_by_elevation_with_other_headings(spark, tmp_path):
    (tmp_path / "b.csv").write_text("bh;x_coord;y_coord;z;elevation;from;to;unit;lithology\nQ7;1;2;55;99;54.5;51;till;T\nQ7;1;2;55;99;47;51;chalk;C\n")
    holes, layers = boreholes.read_boreholes(spark, str(tmp_path / "b.csv"), mode="elevation")
    assert holes.first()["z"] == 55.0  # the first of a column's headings counts
    assert [(r["seq"], r["layer_id"], r["top"], r["bottom"]) for r in layers.orderBy("seq").collect()] == [(1, "till", 54.5, 51.0), (2, "chalk", 51.0, 47.0)]


@pytest.mark.parametrize("binary", [False, True])
def test_stl(spark, tmp_path, binary):
    if binary:
        data = b"\0" * 80 + struct.pack("<I", 4) + b"".join(struct.pack("<12fH", 0, 0, 0, *[x for p in t for x in p], 0) for t in TETRA)
    else:
        data = ("solid t\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in t) + "endloop\nendfacet\n" for t in TETRA) + "endsolid t\n").encode()
    (tmp_path / "t.stl").write_bytes(data)
    facets = surfaces.read_facets(spark, str(tmp_path / "t.stl"))
    triangles, nodes = surfaces.to_mesh(facets)
    assert triangles.count() == 4 and nodes.count() == 4
    assert {r["uses"] for r in mesh.edge_uses(triangles).collect()} == {2}
    q = surfaces.quality(facets).first()
    assert q["triangles"] == 4 and q["degenerate"] == 0 and abs(q["area"] - (1.5 + 3**0.5 / 2)) < 1e-6
    surfaces.write_lines(surfaces.stl_lines(facets), str(tmp_path / "out"))
    (tmp_path / "again.stl").write_text("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()))
    again = surfaces.read_facets(spark, str(tmp_path / "again.stl")).drop("source", "facet").collect()
    assert sorted(map(tuple, again)) == sorted(tuple(float(x) for p in t for x in p) for t in TETRA)
    assert surfaces.latest_facets(facets.union(facets.withColumn("facet", F.col("facet") + 9))).count() == 4


def test_model_json(spark, tmp_path):
    m = {"materials": [{"id": "clay", "model_type": "mc"}], "surfaces": [{"id": "s", "points": [[0, 0, 1], [1, 0, 2]]}], "volumes": [{"id": "v", "bounds": [0, 1, 0, 2, 0, 3], "material_id": "sand"}], "layers": [], "boreholes": [{"id": "b", "x": 0, "y": 0, "layers": [{"top": 1, "bottom": 0, "material_id": "clay"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    t = models.read_model(spark, str(tmp_path / "m.json"))
    assert {(r["id"], r["model_type"]) for r in t["materials"].collect()} == {("clay", "mc"), ("sand", "placeholder")}
    assert t["surface_points"].count() == 2 and t["volumes"].first()["z1"] == 3.0 and t["borehole_layers"].count() == 1


def test_meshes(spark, tmp_path):
    (tmp_path / "a.msh").write_text("$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n4\n1 0 0 0\n2 1 0 0\n3 0 1 0\n4 0 0 1\n$EndNodes\n$Elements\n1\n1 4 2 101 5 1 2 3 4\n$EndElements\n")
    cells, nodes = models.read_mesh(spark, str(tmp_path / "a.msh"), "gmsh")
    assert [(r["cell_type"], r["conn"], r["region"]) for r in cells.collect()] == [("tet4", [1, 2, 3, 4], "layer_101")] and nodes.count() == 4
    piece = "<Piece><Points><DataArray>0 0 0 1 0 0 0 1 0 0 0 1</DataArray></Points><Cells><DataArray Name='connectivity'>0 1 2 3</DataArray><DataArray Name='offsets'>4</DataArray><DataArray Name='types'>10</DataArray></Cells><CellData><DataArray Name='layer'>{}</DataArray></CellData></Piece>"
    (tmp_path / "a.vtu").write_text(f"<VTKFile><UnstructuredGrid>{piece.format(7)}{piece.format(8)}</UnstructuredGrid></VTKFile>")
    cells, nodes = models.read_mesh(spark, str(tmp_path / "a.vtu"), "vtu")
    assert sorted((r["conn"], r["region"]) for r in cells.collect()) == [([0, 1, 2, 3], "layer_7"), ([4, 5, 6, 7], "layer_8")]
    surfaces.write_lines(models.vtk_lines(cells, nodes), str(tmp_path / "vtk"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "vtk")).collect()]
    assert text[4] == "POINTS 8 double" and "CELLS 2 10" in text and text[-2:] == ["1", "1"]


def test_kinds():
    assert kind_of("a/B.STL") == "stl" and kind_of("x", " Geology-JSON ") == "geology_json"
    with pytest.raises(ValueError):
        kind_of("x.doc")


def test_idw_hits_its_samples(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0), (1, 2, 1.0, 0.0, 9.0)], "surface int, seq int, x double, y double, z double")
    g = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 1, 0, 0.5, 0.0), (2, 0, 0, 0.0, 0.0)], "surface int, i int, j int, x double, y double")
    assert {(r["surface"], r["i"]): r["z"] for r in geology.idw_grid(s, g).collect()} == {(1, 0): 5.0, (1, 1): 7.0, (2, 0): None}
    assert np.isfinite(5.0)


def test_ranges_of_any_size_give_the_same_facets(spark, tmp_path):
    tris = [[float(np.float32(x)) for x in np.random.default_rng(k).normal(size=9)] for k in range(40)]
    text = "solid a facet of note\n" + "".join("  FACET normal 0 0 1\n outer loop\n" + "".join(f"  vertex {t[i]!r} {t[i + 1]!r} {t[i + 2]!r}\n" for i in (0, 3, 6)) + " endloop\nendfacet\n" for t in tris)
    text += "facet normal 0 0 0\nouter loop\nvertex 0 0 0\nvertex 1 1 1\nendloop\nendfacet\nfacet normal 0 0 0\nouter loop\nvertex 1 2 3\n"  # two vertices, and no end
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a b.stl").write_text(text)
    (tmp_path / "s" / "b.stl").write_bytes(b"solid but binary".ljust(80, b"\0") + struct.pack("<I", 40) + b"".join(struct.pack("<12fH", 0, 0, 1, *t, 0) for t in tris))
    (tmp_path / "s" / "c.stl").write_bytes(b"")
    (tmp_path / "s" / "d.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 9) + b"".join(struct.pack("<12fH", 0, 0, 1, *t, 0) for t in tris[:2]) + b"cut")
    got = []
    for size in (37, 200, 5000, 1 << 24):
        df = surfaces.read_facets(spark, str(tmp_path / "s"), size=size)
        assert size > 5000 or df.rdd.getNumPartitions() > 3
        got.append(sorted((r["source"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in df.collect()))
    assert got[0] == got[1] == got[2] == got[3]
    by = {n: [r[2:] for r in got[0] if r[0] == n] for n in ("a b.stl", "b.stl", "d.stl")}
    assert by["a b.stl"] == by["b.stl"] == [tuple(t) for t in tris] and len(by["d.stl"]) == 2 and [r[1] for r in got[0] if r[0] == "b.stl"] == list(range(40))


def test_ranges_of_any_size_give_the_same_mesh(spark, tmp_path):
    n = 60
    text = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$PhysicalNames\n1\n3 7 \"4 4 4 4\"\n$EndPhysicalNames\n$Nodes\n60\n" + "".join(f"{i + 1} {i}.5 {i * i} -{i}e-1\n" for i in range(n)) + "$EndNodes\n$Elements\n58\n"
    text += "".join(f"{i + 1} 4 2 {i % 5} 9 {i + 1} {i + 2} {i + 3} {i + 4}\n" for i in range(n - 3)) + "99 15 2 0 0 1\n$EndElements"
    (tmp_path / "m.msh").write_text(text)
    got = []
    for size in (11, 150, 1 << 24):
        cells, nodes = models.read_mesh(spark, str(tmp_path / "m.msh"), "gmsh", size=size)
        got.append((sorted(map(tuple, cells.drop("source").collect())), sorted(map(tuple, nodes.drop("source").collect()))))
    assert got[0] == got[1] == got[2]
    assert got[0][1] == [(i + 1, i + 0.5, float(i * i), float(f"-{i}e-1")) for i in range(n)]
    assert got[0][0] == [(i + 1, "tet4", [i + 1, i + 2, i + 3, i + 4], f"layer_{i % 5}") for i in range(n - 3)]


def test_one_file_in_order(spark, tmp_path):
    from groundframe.sources import splits

    lines = spark.range(3000).repartition(7).select((F.col("id") * 37 % 3000).alias("n"), F.concat(F.lit("line "), (F.col("id") * 37 % 3000).cast("string")).alias("line"))
    path = str(tmp_path / "out.txt")
    splits.write_file(lines, path, size=1000)
    want = "".join(f"line {n}\n" for n in range(3000))
    assert (tmp_path / "out.txt").read_text() == want and [p.name for p in tmp_path.iterdir()] == ["out.txt"]
    with pytest.raises(FileExistsError):
        splits.write_file(lines, path)
    with pytest.raises(ValueError):
        splits.write_file(lines, "hdfs://host/out.txt")
    splits.write_file(lines.limit(0), str(tmp_path / "none.txt"))
    assert (tmp_path / "none.txt").read_text() == ""


def test_a_repeated_task_writes_the_same_bytes(spark, tmp_path, monkeypatch):
    from groundframe.sources import splits

    once = splits.ranges
    monkeypatch.setattr(splits, "ranges", lambda *a: (lambda df: df.union(df))(once(*a)))  # every range is copied twice, side by side
    lines = spark.range(500).select(F.col("id").alias("n"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("line"))
    with pytest.raises(OSError):  # twice as many bytes as the file has
        splits.write_file(lines, str(tmp_path / "out.txt"), size=100)
    (left,) = tmp_path.iterdir()
    assert left.name != "out.txt" and left.read_text() == "".join(f"é {n}\n" for n in range(500))


def test_short_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "long.txt").write_text("0123456789\n" * 5000)
    parts = splits.ranges(spark, str(tmp_path / "long.txt"), size=100)
    assert parts.count() == 550 and parts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_borehole_text_is_parsed_once(spark, tmp_path):
    (tmp_path / "b.csv").write_text("bh_id,x,y,z,top,bottom,unit\na,1,2,10,0,3,clay\na,1,2,10,3,5,sand\n")
    holes, layers = boreholes.read_boreholes(spark, str(tmp_path / "b.csv"))
    points = boreholes.control_points(holes, layers)
    assert "FileScan csv" not in points._jdf.queryExecution().executedPlan().toString()
    assert points.count() == 4 and layers.count() == 2
