"""Mesh queries: a lattice of hexahedra out of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import mesh
from ..session import table
from .views import CELLS_SQL, FACES_SQL, NX, NY, VOX_SQL, cells, vox

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("mesh_region_report", f"""WITH {FACES_SQL},
n AS (SELECT region, count(DISTINCT node) AS nodes FROM (SELECT region, unnest(conn) AS node FROM cells) GROUP BY region),
s AS (SELECT kind, region_a AS region FROM kinds WHERE kind IN ('boundary', 'interface') UNION ALL SELECT kind, region_b FROM kinds WHERE kind = 'interface'),
f AS (SELECT region, count(*) FILTER (WHERE kind = 'boundary') AS boundary_faces, count(*) FILTER (WHERE kind = 'interface') AS interface_faces FROM s GROUP BY region)
SELECT region, cells, nodes, coalesce(boundary_faces, 0) AS boundary_faces, coalesce(interface_faces, 0) AS interface_faces
FROM (SELECT region, count(*) AS cells FROM cells GROUP BY region) JOIN n USING (region) LEFT JOIN f USING (region)""")  # fmt: skip
def region_report(spark, sf):
    """AGG-01, GEN-02."""
    return mesh.region_report(cells(spark, sf))


@query("mesh_face_kinds", f"WITH {FACES_SQL} SELECT kind, region_a, region_b, count(*) AS faces FROM kinds GROUP BY ALL")
def face_kinds(spark, sf):
    """AGG-02."""
    return mesh.face_uses(cells(spark, sf)).groupBy("kind", "region_a", "region_b").agg(F.count("*").alias("faces"))


@query("mesh_boundary_adjacency", f"WITH {FACES_SQL} SELECT region_a, region_b, count(*) AS faces FROM kinds WHERE kind = 'interface' GROUP BY ALL HAVING count(*) >= 10")
def boundary_adjacency(spark, sf):
    """JOIN-02."""
    return mesh.region_boundary_adjacency(cells(spark, sf), 10)


@query("mesh_nonmanifold", f"""WITH {FACES_SQL} SELECT uses, count(*) AS n FROM uses GROUP BY uses UNION ALL
SELECT -1, coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM cells GROUP BY list_sort(conn))""")
def nonmanifold(spark, sf):
    """AGG-03."""
    return mesh.nonmanifold_report(cells(spark, sf))


@query("mesh_region_points", """WITH p AS (SELECT DISTINCT l_suppkey AS region, l_partkey AS point FROM lineitem)
SELECT a.region AS region_a, b.region AS region_b, count(*) AS shared FROM p a JOIN p b ON a.point = b.point AND a.region < b.region GROUP BY ALL HAVING count(*) >= 3""")
def region_points(spark, sf):
    """JOIN-01, SET-14."""
    return mesh.region_adjacency(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("point")), 3)


@query("mesh_edge_uses", """WITH t AS (SELECT p_partkey % 97 AS a, p_partkey % 89 + 100 AS b, p_size AS c FROM part),
e AS (SELECT unnest([[least(a, b), greatest(a, b)], [least(b, c), greatest(b, c)], [least(c, a), greatest(c, a)]]) AS e FROM t)
SELECT e[1] AS a, e[2] AS b, count(*) AS uses FROM e GROUP BY ALL""")
def edge_uses(spark, sf):
    """AGG-05."""
    k = F.col("p_partkey")
    return mesh.edge_uses(table(spark, sf, "part").select(F.array(k % 97, k % 89 + 100, F.col("p_size").cast("long")).alias("conn")))


@query("mesh_coarsen", f"""WITH {VOX_SQL}, c AS (SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, label, count(*) AS n FROM vox GROUP BY ALL)
SELECT i, j, k, arg_min(label, (-n, label)) AS label, CAST(sum(n) AS BIGINT) AS voxels FROM c GROUP BY i, j, k""")
def coarsen(spark, sf):
    """Majority coarsening of label voxels."""
    return mesh.coarsen_voxels(vox(spark, sf), 2, 2, 2)


@query("mesh_layers", f"""WITH {VOX_SQL}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM vox)
SELECT label, 'layer_' || lpad(CAST(CASE WHEN hi > lo THEN least(11, floor((hi - value) / ((hi - lo) / 12))) ELSE 0 END AS INTEGER)::VARCHAR, 2, '0') AS layer, count(*) AS cells
FROM vox, b GROUP BY ALL""")
def layers(spark, sf):
    """FN-07, AGG-15."""
    return mesh.layer_tags(vox(spark, sf), F.col("value"), 12).groupBy("label", "layer").agg(F.count("*").alias("cells"))


@query("mesh_merge_nodes", """WITH n AS (SELECT s_suppkey AS node_id, s_acctbal AS x, (s_suppkey % 5)::DOUBLE AS y, s_nationkey::DOUBLE AS z FROM supplier),
k AS (SELECT *, round_even(x / 500, 0) AS kx, round_even(y / 500, 0) AS ky, round_even(z / 500, 0) AS kz FROM n)
SELECT node_id, min(node_id) OVER w AS new_id, first(x) OVER (w ORDER BY node_id) AS x, first(y) OVER (w ORDER BY node_id) AS y, first(z) OVER (w ORDER BY node_id) AS z
FROM k WINDOW w AS (PARTITION BY kx, ky, kz)""")
def merge_nodes(spark, sf):
    """SET-03."""
    c = F.col
    nodes = table(spark, sf, "supplier").select(c("s_suppkey").alias("node_id"), c("s_acctbal").alias("x"), (c("s_suppkey") % 5).cast("double").alias("y"), c("s_nationkey").cast("double").alias("z"))
    return mesh.merge_nodes(nodes, 500.0)


@query("mesh_tet_volumes", f"WITH {CELLS_SQL} SELECT region, count(*) * 5 AS tets, count(*)::DOUBLE AS volume, 0::BIGINT AS inverted FROM cells GROUP BY region")
def tet_volumes(spark, sf):
    """GEN-07, PRJ-01, PRJ-02: five tetrahedra fill each unit hexahedron, none inverted (in absolute volume)."""
    c = cells(spark, sf)
    tets = mesh.split_with_points(c, mesh.lattice_nodes(c, NX, NY), mesh.hex_to_tets)
    v = g.tet_volume(F.col("pts"))
    return tets.groupBy("region").agg(F.count("*").alias("tets"), F.round(F.sum(v), 6).alias("volume"), F.count_if(v <= 0).alias("inverted"))


@query("mesh_quality", f"WITH {CELLS_SQL} SELECT region, count(*) AS cells, 1.0::DOUBLE AS least, round(sqrt(3), 6) AS aspect, 0::BIGINT AS bad FROM cells GROUP BY region")
def quality(spark, sf):
    """AGG-07, AGG-10, PRJ-03, PRJ-11."""
    c = cells(spark, sf)
    out = mesh.region_quality(mesh.cell_quality(c, mesh.lattice_nodes(c, NX, NY)))
    return out.withColumn("aspect", F.round("aspect", 6))


@query("mesh_optimise", f"WITH {CELLS_SQL} SELECT region, count(*) AS cells FROM cells GROUP BY region")
def optimise(spark, sf):
    """SET-04, SET-05: merging at a fine tolerance changes nothing; copies of cells go."""
    c = cells(spark, sf)
    nodes = mesh.lattice_nodes(c, NX, NY)
    k = F.col("cell_id")
    twice = c.withColumn("cell_id", 2 * k).union(c.withColumn("cell_id", 2 * k + 1))
    kept, _ = mesh.optimise(twice, nodes, 1e-6, drop_copies=True)
    return kept.groupBy("region").agg(F.count("*").alias("cells"))
