"""Nothing whole through the driver, and results that don't hang on the order of sums."""

import pytest
from pyspark.sql import functions as F

import groundframe.plans as plans
from groundframe.operators import faces, geology, mesh, quality
from groundframe.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_contacts", "block_touching", "block_contact_assets", "topo_contacts", "topo_lineage", "topo_closest", "model_crossing", "voxel_report", "voxel_filled", "voxel_mesh", "model_matches"])
def test_tables_that_grow_are_never_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in plan(plans.QUERIES[name](spark, sf))


def test_matches_shuffle_only_the_best(spark, sf):
    tree = plans.QUERIES["model_matches"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in tree and tree.count("Aggregate") == 1


def test_a_volume_of_none_isnt_negative(spark):
    corner = [(x, y, z) for z in (2, 3) for x, y in ((0, 5), (1, 5), (1, 6), (0, 6))]
    tris = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 7, 6), (0, 1, 5), (0, 5, 4), (3, 6, 2), (3, 7, 6), (0, 4, 7), (0, 7, 3), (1, 2, 6), (1, 6, 5)]  # the fourth is turned round
    rows = [(1, i, [tuple(map(float, corner[c])) for c in t]) for i, t in enumerate(tris)]
    soup = spark.createDataFrame(rows, "region long, tri_id long, pts array<struct<x:double,y:double,z:double>>").coalesce(1)
    (row,) = faces.oriented(soup).select("volume", "closed", "flip", F.col("turned") > 0).collect()
    assert tuple(row) == (0.0, True, False, True)


def test_nearest_compares_places_not_points(spark):
    """40,000 points and as many candidates on four places: 16 pairs of places, where all pairs were 1.6 billion."""
    at = [((F.col("id") % 2).cast("double")).alias("x"), (F.floor(F.col("id") / 2) % 2 * 4.0).alias("y"), F.lit(0.0).alias("z")]
    a, b = spark.range(40_000).select("id", *at), spark.range(40_000).select((F.col("id") + 8).alias("id"), *at)
    out = geology.nearest(a, b, 3.0)
    assert {tuple(r) for r in out.select(F.col("id") % 4, "near", "distance").distinct().collect()} == {(k, k + 8, 0.0) for k in range(4)}
    assert out.count() == 40_000
    out.write.format("noop").mode("overwrite").save()
    assert "BroadcastHashJoin" not in plan(out)


def test_nearest_takes_the_smallest_id_of_equal_ones(spark):
    schema = "id long, x double, y double, z double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 50.0, 0.0, 0.0), (3, -0.0, 0.0, 0.0), (4, None, 0.0, 0.0)], schema)
    b = spark.createDataFrame([(9, 1.0, 0.0, 0.0), (7, 1.0, 0.0, 0.0), (8, -1.0, 0.0, 0.0), (5, 4.0, 0.0, 0.0)], schema)
    assert sorted(map(tuple, geology.nearest(a, b, 3.0).collect())) == [(1, 7, 1.0), (3, 7, 1.0)]


def test_normals_and_ratios_work_values_out_once(spark, sf):
    tree = plans.QUERIES["geom_shapes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("aggregate(") == 1 and tree.count("array_max(") == 1


def test_a_small_file_of_many_rows_takes_several_tasks(spark, tmp_path):
    spark.range(50_001).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() == 1
    out = spread(df, "id")
    assert out.rdd.getNumPartitions() == 3 and out.count() == 50_001
    assert spread(df.where("id < 5"), "id").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", ["mesh_tet_volumes", "face_six_tets", "face_tet_shapes"])
def test_points_come_to_cells_not_to_their_parts(spark, sf, name):
    """Cells are cut up above the join that brings them their points."""
    tree = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < tree.index("Generate") < tree.index("Join LeftOuter")


def test_ids_and_points_come_to_cells_together(spark, sf):
    tree = plans.QUERIES["mesh_optimise"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("collect_list(") == 1


def test_parts_have_the_points_of_their_nodes(spark):
    c = spark.createDataFrame([(1, "hex8", list(range(8)), "a"), (2, "tet4", [0, 1, 2, 9], "b"), (3, "tet4", [20, 21, 22, 23], "b")], "cell_id long, cell_type string, conn array<long>, region string")
    n = spark.createDataFrame([(i, float(i), float(i * i), 1.0) for i in range(10) if i != 6], "node_id long, x double, y double, z double")
    for split in (mesh.hex_to_tets, quality.hex_to_six):
        want, got = mesh.with_points(split(c), n), mesh.split_with_points(c, n, split)
        assert sorted(map(str, want.collect())) == sorted(map(str, got.select(*want.columns).collect())) and got.count()


def test_pairs_of_regions_are_made_by_more_tasks_for_more_points(spark, monkeypatch):
    monkeypatch.setattr(mesh, "POINTS", 500)
    p = spark.range(9000).select((F.col("id") % 9).alias("region"), F.floor(F.col("id") / 9).alias("point"))
    out = mesh.region_adjacency(p, 3)
    assert "RoundRobin" not in plan(out) and "hashpartitioning(s#" in plan(out) and ", 18)" in plan(out)
    assert sorted(map(tuple, out.collect())) == [(a, b, 1000) for a in range(9) for b in range(a + 1, 9)]


def test_updates_and_their_margin_come_from_one_pass(spark, sf):
    tree = plans.QUERIES["mc_updates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("ArrowEvalPython") == 1 and tree.count("Relation [") == 1
    assert tree.count("forall(") == 2  # one for each array of a row


@pytest.mark.parametrize("name", ["face_bindings", "face_owners"])
def test_counts_of_faces_need_no_points(spark, sf, name):
    tree = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "pts" not in tree and tree.count("Join LeftSemi") == 1


def test_topology_is_dealt_by_the_input(spark):
    """Tasks that count entities follow the number of boxes, whatever partitions the session has; equal corners are one entity, flat and degenerate boxes too."""
    from groundframe.operators import topology as o

    n = 45_000
    k = F.col("id")
    some = spark.range(n).select("id", (k % 5).alias("region"), *((lo + i).cast("double").alias(f"{a}{i}") for a, lo in (("x", k % 40), ("y", F.floor(k / 40) % 25), ("z", F.floor(k / 1000))) for i in (0, 1)))
    cells = o.shared_node_cells(some)
    plans = o.topology_counts(some), o.region_nodes(cells, o.tasks_for(some))
    for plan in plans:
        assert "REPARTITION_BY_NUM" in (text := plan._jdf.queryExecution().executedPlan().toString()) and ", 3), REPARTITION_BY_NUM" in text
    out = {r["kind"]: (r["entities"], r["shared"]) for r in plans[0].collect()}
    nx, ny, nz = 40, 25, 45
    assert out["solid"] == (n, 0) and out["vertex"][0] == (nx + 1) * (ny + 1) * (nz + 1)
    assert out["face"][0] == (nx + 1) * ny * nz + nx * (ny + 1) * nz + nx * ny * (nz + 1) and out["face"][1] == (nx - 1) * ny * nz + nx * (ny - 1) * nz + nx * ny * (nz - 1)
    assert out["edge"][0] == nx * (ny + 1) * (nz + 1) + (nx + 1) * ny * (nz + 1) + (nx + 1) * (ny + 1) * nz
    regions = {r["region"]: r["corners"] for r in plans[1].collect()}
    assert regions == {i: 8 * n // 5 for i in range(5)}
    flat = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, -0.0, 0.0, 0.0, 1.0), (3, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0), (4, None, 1.0, 0.0, 0.0, 0.0, 1.0)], "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    corner = lambda b: [tuple((-1e9 if b[f"{k}{s}"] is None else b[f"{k}{s}"] + 0.0) for k, s in zip("xyz", c, strict=True)) for c in o.CORNERS]
    want = {}
    for kind, of in (("face", list(o.BOX_FACES.values())), ("edge", o.BOX_EDGES), ("vertex", [(i,) for i in range(8)])):
        met = {}
        for b in flat.collect():
            for f in of:
                met.setdefault(tuple(sorted(corner(b)[i] for i in f)), set()).add(b["id"])
        want[kind] = (len(met), sum(len(x) > 1 for x in met.values()))
    assert {r["kind"]: (r["entities"], r["shared"]) for r in o.topology_counts(flat).collect() if r["kind"] != "solid"} == want
