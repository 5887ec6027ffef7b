import math

import pytest
from pyspark.sql import functions as F

from groundframe.operators import faces, graph, layers, mesh, quality, shapes, stages, topology
from groundframe.operators import geometry as g

BOX = "id long, region string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def test_layers_between_surfaces(spark):
    rows = [(layer, i, j, float(i), float(j), 10.0 - layer, 9.0 - layer - (i == 0)) for layer in range(3) for i in range(3) for j in range(3)]
    grid = spark.createDataFrame(rows, "layer long, i long, j long, x double, y double, top double, bottom double")
    cells = layers.layered_mesh(grid, 3, 3).collect()
    nodes = {n for c in cells for n in c["conn"]}
    assert len(cells) == 12 and len(nodes) == 3 * 2 * 9 and all(len(set(c["conn"])) == 8 for c in cells)
    assert {c["volume"] for c in cells} == {1.0, 2.0}
    flat = grid.withColumn("bottom", F.col("top"))
    assert layers.layered_mesh(flat, 3, 3).count() == 0 and layers.layered_mesh(grid.where("i <> 1"), 3, 3).count() == 0


def test_default_soil_layer(spark):
    bounds = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 4.0)], "model long, z0 double, z1 double")
    rows = spark.createDataFrame([(2, "a", 9.0, 3.0), (2, "b", -5.0, 1.0), (2, "c", 7.0, 8.0), (1, "d", 1.0, 2.0)], "model long, layer string, a double, b double")
    out = {(r["model"], r["seq"]): (r["layer"], r["z_min"], r["z_max"], r["below"]) for r in layers.soil_layers(rows, bounds).collect()}
    assert out == {(1, 1): ("soil_layer", 0.0, 1.0, None), (2, 1): ("b", 0.0, 1.0, None), (2, 2): ("a", 3.0, 4.0, "b")}


def test_labels_by_majority(spark):
    cells = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [3, 4, 5, 9])], "cell_id long, conn array<long>")
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "b"), (4, "a"), (5, "c")], "node_id long, label string")
    assert {r["cell_id"]: r["label"] for r in layers.cell_labels(cells, labels).collect()} == {1: "x", 2: "a"}


def test_regular_tetrahedron(spark):
    pts = [(0, 1.0, 1.0, 1.0), (1, 1.0, -1.0, -1.0), (2, -1.0, 1.0, -1.0), (3, -1.0, -1.0, 1.0)]
    nodes = spark.createDataFrame(pts, "node_id long, x double, y double, z double")
    cells = spark.createDataFrame([(1, "tet4", [0, 1, 2, 3], "a"), (2, "tet4", [0, 2, 1, 3], "b")], "cell_id long, cell_type string, conn array<long>, region string")
    out = {r["cell_id"]: r for r in quality.tet_quality(cells, nodes).collect()}
    assert all(abs(out[1][c] - math.degrees(math.acos(1 / 3))) < 1e-9 for c in ("low_angle", "high_angle"))
    assert abs(abs(out[1]["volume"]) - 8 / 3) < 1e-12 and out[1]["volume"] == -out[2]["volume"]
    assert {k: r["inverted"] for k, r in out.items()} == {k: r["volume"] <= 0 for k, r in out.items()} and not out[1]["sliver"]


def test_bad_cells_are_cut_up(spark):
    cells = spark.createDataFrame([(1, "tet4", [0, 1, 2, 3], "a"), (2, "hex8", list(range(8)), "b"), (3, "hex8", list(range(8)), "c"), (4, "tet4", [4, 5, 6, 7], "d")], "cell_id long, cell_type string, conn array<long>, region string")
    bad = spark.createDataFrame([(1, 1.0, 0.1), (2, 1.0, 0.1), (4, 0.05, 0.1)], "cell_id long, measure double, least double")
    out = quality.refined(cells, bad, F.col("cell_id") + 100).collect()
    assert sorted((r["region"], r["cell_type"]) for r in out) == [("a", "tet4")] * 4 + [("b", "tet4")] * 5 + [("c", "hex8")]
    assert all(101 in r["conn"] for r in out if r["region"] == "a") and len({r["cell_id"] for r in out}) == len(out)


def test_plane_through_a_cube_is_a_hexagon(spark):
    box = spark.createDataFrame([(1, "a", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], BOX)
    plane = {"px": 0.5, "py": 0.5, "pz": 0.5, "nx": 1.0, "ny": 1.0, "nz": 1.0}
    r = shapes.plane_cut(box.withColumns({k: F.lit(v) for k, v in plane.items()})).select(F.size("polygon"), g.polygon_area(F.col("polygon"))).first()
    assert r[0] == 6 and abs(r[1] - 3 * math.sqrt(3) / 4) < 1e-8
    far = {**plane, "px": 9.0}
    assert shapes.plane_cut(box.withColumns({k: F.lit(v) for k, v in far.items()})).first()["polygon"] is None


def test_square_moved_outward(spark):
    ring = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])], "outline long, seq long, x double, y double")
    out = {(r["x"], r["y"]): (r["ox"], r["oy"]) for r in shapes.offset_outline(ring, 1.0).collect()}
    assert out == {(0, 0): (-1, -1), (4, 0): (5, -1), (4, 4): (5, 5), (0, 4): (-1, 5)}
    bow = spark.createDataFrame([(2, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 4), (4, 0), (0, 4)])], ring.schema)
    checks = {r["outline"]: (r["points"], r["area"], r["crossings"], r["repeated"]) for r in shapes.outline_checks(ring.union(bow)).collect()}
    assert checks == {1: (4, 16.0, 0, 0), 2: (4, 0.0, 1, 0)}


def test_turned_box(spark):
    box = spark.createDataFrame([(1, "a", 0.0, 2.0, 0.0, 1.0, 0.0, 1.0)], BOX)
    r = box.withColumns(shapes.transformed(F.lit(1.0), F.lit(90.0), {k: F.lit(10.0) for k in "xyz"})).first()
    assert [round(r[c], 9) for c in ("x0", "x1", "y0", "y1", "z0", "z1")] == [9.0, 10.0, 10.0, 12.0, 10.0, 11.0]


def test_stages_emptied_twice(spark):
    regions = spark.createDataFrame([("a",), ("b",)], "region string")
    order = spark.createDataFrame([(f"s{k}", k) for k in range(5)], "stage string, seq long")
    said = [("s0", "a", "activate", True), ("s0", "a", "deactivate", False), ("s1", "b", "map", False), ("s2", "a", "deactivate", False), ("s2", "a", "action_activate", True), ("s2", "a", "map", False), ("s3", "a", "map", False), ("s3", "b", "action_deactivate", False)]
    out = stages.stage_states(regions, order, spark.createDataFrame(said, "stage string, region string, kind string, active boolean"))
    got = {r["stage"]: set() for r in out.collect()}
    for r in out.where("is_active").collect():
        got[r["stage"]].add(r["region"])
    assert got == {"s0": {"b"}, "s1": {"a", "b"}, "s2": {"a", "b"}, "s3": {"a", "b"}, "s4": {"a", "b"}}


def test_surface_repair_and_orientation(spark):
    p = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    tris = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    point = lambda i: dict(zip("xyz", p[i], strict=True))
    rows = [("shut", k, [point(i) for i in t]) for k, t in enumerate(tris)] + [("open", k, [point(i) for i in t]) for k, t in enumerate(tris[:3])] + [("inside_out", k, [point(i) for i in t[::-1]]) for k, t in enumerate(tris)]
    df = spark.createDataFrame(rows, "region string, tri_id long, pts array<struct<x:double,y:double,z:double>>")
    rep = {r["region"]: (r["open_edges"], r["closed"], r["conformal"], r["corners"]) for r in faces.surface_repair(df).collect()}
    assert rep == {"shut": (0, True, True, 4), "open": (3, False, False, 4), "inside_out": (0, True, True, 4)}
    assert {r["region"]: (round(r["volume"], 9), r["flip"]) for r in faces.oriented(df).where("closed").collect()} == {"shut": (round(1 / 6, 9), False), "inside_out": (round(-1 / 6, 9), True)}


@pytest.mark.parametrize("size", [1.0, 1000.0])
def test_face_contacts_at_any_size(spark, size):
    n = 6
    rows = [(i * n + j, "a", i * size, (i + 1) * size, j * size, (j + 1) * size, 0.0, size) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, BOX)
    out = topology.face_contacts(df).collect()
    assert len(out) == 2 * n * (n - 1) and {r["area"] for r in out} == {size * size}
    from groundframe.operators import blocks

    assert blocks.block_contacts(df).count() == len(out)
    assert blocks.touching_regions(df).count() == len(out) + 2 * (n - 1) ** 2
    shared = mesh.face_uses(topology.shared_node_cells(df).select("cell_id", "region", F.lit("hex8").alias("cell_type"), F.transform("conn", lambda q: F.xxhash64(q)).alias("conn")))
    assert shared.where("uses = 2").count() == len(out)


def walk(edges):
    """Loops by walking: at a node, edges go on in pairs by their other ends."""
    ends = {}
    for a, b in {tuple(sorted(e)) for e in edges if e[0] != e[1]}:
        ends.setdefault(a, []).append(b)
        ends.setdefault(b, []).append(a)
    ends = {k: sorted(v) for k, v in ends.items()}

    def onward(a, b):
        own = ends[b]
        k = own.index(a) ^ 1
        return (b, own[k]) if k < len(own) else None

    out = {}
    for dart in sorted((a, b) for a in ends for b in ends[a]):
        path, at = [dart], onward(*dart)
        while at and at != dart:
            path.append(at)
            at = onward(*path[-1])
        begins = onward(dart[1], dart[0]) is None
        if (at == dart and min(path) == dart) or (at is None and begins):
            key = frozenset(frozenset(d) for d in path)
            if key not in out or path[0] < out[key][0][0]:
                out[key] = (path, at == dart)
    return {(*p[0], n, *d, closed) for p, closed in out.values() for n, d in enumerate(p)}


def test_boundary_loops(spark):
    ring = [(i, (i + 1) % 6, 6 + i) for i in range(6)] + [((i + 1) % 6, 6 + (i + 1) % 6, 6 + i) for i in range(6)]  # a band between two hexagons
    bow = [(20, 21, 22), (20, 23, 24)]  # two triangles that meet in a node
    df = spark.createDataFrame([([a, b, c],) for a, b, c in ring + bow], "conn array<long>")
    assert {tuple(r) for r in graph.boundary_loops(df).collect()} == {(0, 1, True, 6), (6, 7, True, 6), (20, 21, True, 3), (20, 23, True, 3)}


def test_traced_loops_equal_the_walk(spark):
    import random

    rng = random.Random(6)
    edges = [(i, (i + 1) % 200) for i in range(200)] + [(300 + i, 301 + i) for i in range(70)] + [(rng.randrange(400, 440), rng.randrange(400, 440)) for _ in range(90)] + [(3, 3), (1, 0)]
    df = spark.createDataFrame(edges, "source long, target long")
    got = {tuple(r) for r in graph.traced(df).select("first", "second", "place", "source", "target", "closed").collect()}
    assert got == walk(edges) and {r[5] for r in got} == {True, False}
    assert graph.traced(df.limit(0)).count() == 0 and graph.components(df.limit(0)).count() == 0


def test_project_round_trip(spark, tmp_path):
    from groundframe.sources import models

    rows = spark.createDataFrame([(1, "a", None), (2, "b;,\"c", 2.5)], "id long, name string, z double")
    models.save_project({"volumes": rows, "layers": rows.limit(0)}, str(tmp_path / "p"))
    got = models.load_project(spark, str(tmp_path / "p"), {"volumes": "id long, name string, z double", "layers": "id long, name string, z double"})
    assert sorted(map(tuple, got["volumes"].collect())) == sorted(map(tuple, rows.collect())) and got["layers"].count() == 0
    models.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True, schema="id long, name string, z double").collect())) == sorted(map(tuple, rows.collect()))


def test_short_loops_leave_the_rounds_of_long_ones(spark, monkeypatch):
    sizes = []

    class Counted(graph.Rounds):
        def written(self, writer):
            path = super().written(writer)
            sizes.append(self.spark.read.parquet(path).count())
            return path

    monkeypatch.setattr(graph, "Rounds", Counted)
    rows = [(3 * k + i, 3 * k + (i + 1) % 3) for k in range(100) for i in range(3)] + [(1000 + i, 1000 + (i + 1) % 64) for i in range(64)]
    out = graph.traced(spark.createDataFrame(rows, "source long, target long"))
    assert out.count() == 364 and out.where("closed").groupBy("first", "second").count().count() == 101
    assert sizes[0] == 728 and sizes[-1] <= 128
