import numpy as np
import pytest
from pyspark.sql import functions as F

from groundframe.functions import safe_id, stable_hash
from groundframe.operators import blocks, graph, mesh, stages
from groundframe.operators import geometry as g

UNIT_TET = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]


def tet(spark, nodes=UNIT_TET, e=1000.0, nu=0.25):
    cells = spark.createDataFrame([(0, "tet4", [0, 1, 2, 3], "a")], "cell_id long, cell_type string, conn array<long>, region string")
    nodes = spark.createDataFrame(nodes, "node_id long, x double, y double, z double")
    return mesh.with_points(cells, nodes).withColumns({"e": F.lit(e), "nu": F.lit(nu)}), cells, nodes


def test_hexahedra_have_ten_boundary_faces_and_one_inside(spark):
    vox = spark.createDataFrame([(0, 0, 0, "rock"), (1, 0, 0, "rock")], "i long, j long, k long, label string")
    kinds = {r["kind"]: r["n"] for r in mesh.face_uses(mesh.hex_lattice(vox, 2, 1)).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"boundary": 10, "internal": 1}


@pytest.mark.parametrize("n", [(3, 4, 2), (5, 5, 5)])
def test_lattice_boundary_is_its_closed_form(spark, n):
    a, b, c = n
    vox = spark.range(a * b * c).select((F.col("id") % a).alias("i"), (F.floor(F.col("id") / a) % b).alias("j"), F.floor(F.col("id") / (a * b)).alias("k"), F.lit("s").alias("label"))
    assert mesh.face_uses(mesh.hex_lattice(vox, a, b)).where("kind = 'boundary'").count() == 2 * (a * b + a * c + b * c)


def test_columns_of_geometry(spark):
    _, cells, nodes = tet(spark)
    p = F.col("pts")
    r = mesh.with_points(cells, nodes).select(
        g.tet_volume(p).alias("v"), g.signed_tet_volume(p).alias("s"), g.bbox_volume(p).alias("b"), g.aspect_ratio(p).alias("a"), g.centroid(p).alias("c"), g.polygon_area(F.slice(p, 1, 3)).alias("f"), g.polygon_normal(F.slice(p, 1, 3)).alias("n"), g.signed_area_xy(F.slice(p, 1, 3)).alias("xy"), g.radius_ratio(p).alias("q"), g.triangle_normal(p).alias("t"),
    ).first()
    assert abs(r["v"] - 1 / 6) < 1e-12 and r["s"] > 0 and r["b"] == 1.0 and abs(r["a"] - 2**0.5) < 1e-12
    assert tuple(r["c"]) == (0.25, 0.25, 0.25) and r["f"] == 0.5 and tuple(r["n"]) == (0.0, 0.0, 1.0) == tuple(r["t"]) and r["xy"] == 0.5 and 0 < r["q"] <= 1


def test_components_and_neighbours(spark):
    e = spark.createDataFrame([(5, 3, "contacts"), (3, 9, "contacts"), (7, 8, "owns"), (2, 2, "owns")] + [(100 + i, 101 + i, "contacts") for i in range(40)], "source long, target long, relation string")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7} | {100 + i: 100 for i in range(41)}
    assert {(r["node"], r["other"]) for r in graph.neighbours(e.where("source < 10"), ["owns"]).collect()} == {(7, 8), (8, 7)}
    assert {r["node"] for r in graph.dangling(e.where("source < 10")).collect()} == {5, 9, 7, 8}


def test_cut_box_keeps_its_volume(spark):
    box = spark.createDataFrame([(1, "a", 0.0, 4.0, 0.0, 4.0, 0.0, 4.0)], "id long, region string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    cutter = spark.createDataFrame([(1, 1.0, 2.0, 1.0, 9.0, 1.0, 2.0)], "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    out = blocks.subtract_boxes(box, cutter).agg(F.count("*"), F.sum(g.box_volume())).first()
    assert tuple(out) == (5, 61.0)
    assert blocks.subtract_boxes(box, cutter.where("id = 2")).first()["part"] == 0


def test_stage_predicates(spark):
    df = spark.createDataFrame([("a", ["b"], []), ("b", ["b"], ["a", "b"]), ("c", [], ["a"]), ("d", None, None)], "block string, inactive array<string>, active array<string>")
    got = {r[0]: r[1] for r in df.select("block", stages.block_active(F.col("block"), F.col("inactive"), F.col("active"))).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}
    assert [r[0] for r in df.select(stages.active_in(F.col("active"), F.lit("a"))).collect()] == [True, True, True, True]


def test_names_and_hashes(spark):
    df = spark.createDataFrame([("  Soft Clay (2) ",), ("",), (None,), ("3a",)], "t string")
    assert [r[0] for r in df.select(safe_id(F.col("t"))).collect()] == ["soft_clay_2", "item", "item", "item_3a"]
    assert len({r[0] for r in df.select(stable_hash(F.col("t"))).collect()}) == 4
