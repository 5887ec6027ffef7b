"""Queries that write derived tables to files in the shared folder and read them back in ranges, and those on columns that only files use."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as f
from ..operators import geometry as g
from ..operators import mesh, stages
from ..operators.tiles import sorted_join
from ..session import shared_dir, spread, table
from ..sources import boreholes, kind_of, models, splits, surfaces
from .views import BH_SQL, BOXES_SQL, CELLS_SQL, NX, NY, borehole_rows, boxes, cells
from .voxels import CORNERS, TRIS

#: Bytes of a range: a few thousand lines, so that files of small tables take several.
SIZE = 1 << 17


def _new(spark, suffix: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def stl(spark, sf):
    """SRC-05 to SRC-09, SRC-20, SNK-05, WIN-13: boxes as a text STL file and back, by their left sides."""
    corner = [g.point(*(F.col(e) for e in names.split())) for names in CORNERS]
    t = boxes(spark, sf).select("id", F.posexplode(F.array(*(F.array(*(corner[i] for i in t)) for t in TRIS))).alias("part", "p"))
    facets = t.select((F.col("id") * 12 + F.col("part")).alias("facet"), *(F.col("p")[i][k].alias(f"{k}{i}") for i in range(3) for k in "xyz"))
    path = _new(spark, ".stl")
    splits.write_file(surfaces.stl_lines(facets), path, SIZE)
    back = {"stl": surfaces.read_facets}[kind_of(path)](spark, path, size=SIZE)
    p = F.array(*(g.point(*(F.col(f"{k}{i}") for k in "xyz")) for i in range(3)))
    out = back.withColumns({"left": F.least("x0", "x1", "x2"), "area": g.triangle_area(p[0], p[1], p[2])})
    return out.groupBy("left").agg(F.count("*").alias("facets"), F.round(F.sum("area"), 4).alias("area"), F.sum(F.col("y0") + F.col("y1") + F.col("y2")).alias("y"), F.max("z0").alias("top"))


def _gmsh_lines(c, n):
    """(n, line) of a Gmsh 2 text mesh."""
    numbers = lambda *x: F.concat_ws(" ", *(v.cast("string") for v in x))
    line = lambda at, text: F.struct(F.lit(at).cast("long").alias("n"), text.alias("line"))
    block = 1 << 40
    nodes = n.select((block + F.col("node_id")).alias("n"), numbers(F.col("node_id") + 1, *(F.col(k) for k in "xyz")).alias("line"))
    elements = c.select((3 * block + F.col("cell_id")).alias("n"), F.concat_ws(" ", (F.col("cell_id") + 1).cast("string"), F.lit("5 2"), F.length("region").cast("string"), F.lit("0"), F.array_join(F.transform("conn", lambda v: (v + 1).cast("string")), " ")).alias("line"))
    counts = c.agg(F.count("*").cast("string").alias("c")).crossJoin(n.agg(F.count("*").cast("string").alias("k")))  # one row each
    heads = F.array(line(0, F.concat(F.lit("$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n"), F.col("k"))), line(2 * block, F.concat(F.lit("$EndNodes\n$Elements\n"), F.col("c"))), line(4 * block, F.lit("$EndElements")))
    return counts.select(F.inline(heads)).union(nodes).union(elements)


def gmsh(spark, sf):
    """SRC-10, SRC-12, SRC-13, SRC-15: a lattice as a Gmsh file and back, by layer."""
    c = cells(spark, sf)
    path = _new(spark, ".msh")
    splits.write_file(_gmsh_lines(c, mesh.lattice_nodes(c, NX, NY)), path, SIZE)
    back, nodes = models.read_mesh(spark, path, kind_of(path), size=SIZE)
    at = back.select("region", "cell_id", F.explode("conn").alias("node_id")).join(nodes, "node_id")
    return at.groupBy("region").agg(F.count_distinct("cell_id").alias("cells"), F.count("*").alias("corners"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"))


def vtk(spark, sf):
    """SNK-02: a lattice as one VTK file, its lines by what they hold."""
    c = cells(spark, sf)
    path = _new(spark, ".vtk")
    splits.write_file(models.vtk_lines(c, mesh.lattice_nodes(c, NX, NY), F.length("region") > 5), path, SIZE)
    text = spark.read.text(path)
    numbers = F.size(F.split("value", " "))
    kind = F.when(F.col("value").rlike("^[A-Z#a-z]"), "heading").when(numbers == 3, "point").when(numbers == 9, "cell").when(F.col("value") == "12", "type").otherwise(F.concat(F.lit("active "), F.col("value")))
    return text.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))


def holes(spark, sf):
    """SRC-02, FN-03, FN-04, AGG-18: borehole logs as CSV and back, by hole; and the box of their control points."""
    b = borehole_rows(spark, sf)
    path = _new(spark, ".csv")
    k = F.col("borehole_id")
    models.write_csv(b.select(k.alias("BH ID"), (k % 13).alias("Easting"), (k % 7).alias("Northing"), F.col("collar").alias("Ground-Level"), F.col("top").alias("from depth"), F.col("bottom").alias("to_depth"), F.col("layer_id").alias("unit"), F.when(F.col("top") > 0, F.col("material_id")).alias("soil")), path)
    tops, layers = boreholes.read_boreholes(spark, path)
    box = boreholes.extent(boreholes.control_points(tops, layers))
    out = layers.groupBy("borehole_id").agg(F.count("*").alias("layers"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.count_if(F.col("material_id").startswith("soil")).alias("unnamed"))
    return out.join(sorted_join(tops), "borehole_id").crossJoin(F.broadcast(box.select("x1", "y1", "z0", "z1")))  # one row


def shapes(spark, sf):
    """PRJ-10, PRJ-14, PRJ-22: normals of quadrangles, shapes of tetrahedra and places on a grid, by part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a, b, c = size / 10.0, (k % 7 + 1) / 3.0, (k % 11 + 1) / 5.0
    zero = F.lit(0.0)
    n = g.polygon_normal(F.array(g.point(zero, zero, zero), g.point(a, zero, c), g.point(a, b, c + 1), g.point(zero, b, F.lit(1.0))))
    tet = F.array(g.point(zero, zero, zero), g.point(a, zero, zero), g.point(F.lit(0.3), b, zero), g.point(F.lit(0.1), F.lit(0.2), c))
    own = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", n.alias("n"), g.radius_ratio(tet).alias("ratio"), g.snapped(size + k % 5 / 4.0, 0.5).alias("snapped"))
    return own.select("p_partkey", *(F.round(F.col("n")[x], 6).alias(f"n{x}") for x in "xyz"), F.round("ratio", 6).alias("ratio"), "snapped")


def keys(spark, sf):
    """FN-06, FN-09, FN-10, FN-20, FN-21: hashes, rounded values, overlaps and names of cell types, by part."""
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, (" Tetra", "HEXA", "quad", "wedge", "Polygon "))), (k % 5).cast("int"))
    over = f.overlap(k % 10, k % 10 + 2, k % 7, k % 7 + 1.5, 0.25)
    return table(spark, sf, "part").select("p_partkey", f.stable_hash(F.col("p_brand"), F.when(k % 3 > 0, F.col("p_size"))).alias("hash"), f.quantised((k % 1000 / 8.0).cast("decimal(10,3)"), 2).cast("double").alias("rounded"), over.alias("overlap"), mesh.cell_type_name(kind).alias("kind"))


def listed(spark, sf):
    """FLT-04 to FLT-06, FLT-11, FLT-15, WIN-06: what a stage's lists say of blocks, by part."""
    k = F.col("p_partkey")
    names = F.array(*map(F.lit, "abcd"))
    some = lambda m, n: F.when(k % m > 0, F.slice(names, (k % n + 1).cast("int"), (k % m).cast("int")))
    block = F.get(names, (k % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", stages.active_in(some(3, 2), block).alias("here"), stages.block_active(block, some(4, 3), some(5, 2)).alias("active"))


QUERIES = {"file_stl": stl, "file_gmsh": gmsh, "file_vtk": vtk, "file_boreholes": holes, "geom_shapes": shapes, "text_keys": keys, "stage_listed": listed}
_C = ", ".join("[" + ", ".join(names.split()) + "]" for names in CORNERS)
_LIST = "(['a', 'b', 'c', 'd'])"
SQL = {
    "file_stl": f"""WITH {BOXES_SQL}, c AS (SELECT id, [{_C}] AS c FROM boxes), t AS (SELECT unnest([{", ".join("[" + ", ".join(f"c[{i + 1}]" for i in t) + "]" for t in TRIS)}]) AS p FROM c),
a AS (SELECT p, 0.5 * sqrt(pow((p[2][2] - p[1][2]) * (p[3][3] - p[1][3]) - (p[2][3] - p[1][3]) * (p[3][2] - p[1][2]), 2) + pow((p[2][3] - p[1][3]) * (p[3][1] - p[1][1]) - (p[2][1] - p[1][1]) * (p[3][3] - p[1][3]), 2)
+ pow((p[2][1] - p[1][1]) * (p[3][2] - p[1][2]) - (p[2][2] - p[1][2]) * (p[3][1] - p[1][1]), 2)) AS area FROM t)
SELECT least(p[1][1], p[2][1], p[3][1]) AS "left", count(*) AS facets, round(sum(area), 4) AS area, sum(p[1][2] + p[2][2] + p[3][2]) AS y, max(p[1][3]) AS top FROM a GROUP BY 1""",
    "file_gmsh": f"""WITH {CELLS_SQL}, n AS (SELECT 'layer_' || length(region) AS region, cell_id, unnest(conn) AS n FROM cells)
SELECT region, count(DISTINCT cell_id) AS cells, count(*) AS corners, sum((n % 21)::DOUBLE) AS x, sum((n // 21 % 21)::DOUBLE) AS y, sum((n // 441)::DOUBLE) AS z FROM n GROUP BY region""",
    "file_vtk": f"""WITH {CELLS_SQL} SELECT 'heading' AS kind, 10 AS lines UNION ALL SELECT 'point', (SELECT count(DISTINCT n) FROM (SELECT unnest(conn) AS n FROM cells)) UNION ALL SELECT 'cell', count(*) FROM cells UNION ALL SELECT 'type', count(*) FROM cells
UNION ALL SELECT 'active ' || CASE WHEN length(region) > 5 THEN '1' ELSE '0' END, count(*) FROM cells GROUP BY 1""",
    "file_boreholes": f"""WITH {BH_SQL}, r AS (SELECT borehole_id, collar, (collar - top)::DOUBLE AS top, (collar - bottom)::DOUBLE AS bottom, top = 0 AS unnamed FROM bh),
h AS (SELECT borehole_id, count(*) AS layers, max(top) AS top, min(bottom) AS bottom, count(*) FILTER (WHERE unnamed) AS unnamed, (borehole_id % 13)::DOUBLE AS x, (borehole_id % 7)::DOUBLE AS y, any_value(collar)::DOUBLE AS z FROM r GROUP BY borehole_id)
SELECT 'bh_' || borehole_id AS borehole_id, layers, top, bottom, unnamed, x, y, z, (SELECT max(x) FROM h) AS x1, (SELECT max(y) FROM h) AS y1, (SELECT min(bottom) FROM r) AS z0, (SELECT max(top) FROM r) AS z1 FROM h""",
    "geom_shapes": """WITH s AS (SELECT p_partkey, p_size, p_size / 10.0::DOUBLE AS a, (p_partkey % 7 + 1) / 3.0::DOUBLE AS b, (p_partkey % 11 + 1) / 5.0::DOUBLE AS c FROM part),
v AS (SELECT *, -2 * b * c AS vx, -2 * a AS vy, 2 * a * b AS vz FROM s), l AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n,
sqrt(greatest(a * a, 0.09 + b * b, 0.05 + c * c, (a - 0.3) * (a - 0.3) + b * b, (a - 0.1) * (a - 0.1) + 0.04 + c * c, 0.04 + (b - 0.2) * (b - 0.2) + c * c)) AS far FROM v)
SELECT p_partkey, round(vx / n, 6) AS nx, round(vy / n, 6) AS ny, round(vz / n, 6) AS nz, round(least(1, pow(2 * a * b * c, 1 / 3.0::DOUBLE) / far), 6) AS ratio, round_even((p_size + p_partkey % 5 / 4.0::DOUBLE) / 0.5, 0) * 0.5 AS snapped FROM l""",
    "text_keys": """SELECT p_partkey, substr(sha1(p_brand || chr(31) || CASE WHEN p_partkey % 3 > 0 THEN p_size::VARCHAR ELSE chr(0) END), 1, 12) AS hash, round_even((p_partkey % 1000)::DOUBLE / 8, 2) AS rounded,
least(p_partkey % 10 + 2, p_partkey % 7 + 1.5) - greatest(p_partkey % 10, p_partkey % 7) > -0.25 AS overlap, ['tet4', 'hex8', 'quad4', 'wedge6', 'polygon'][p_partkey % 5 + 1] AS kind FROM part""",
    "stage_listed": f"""WITH k AS (SELECT p_partkey AS k, {_LIST}[p_partkey % 4 + 1] AS b, CASE WHEN p_partkey % 3 > 0 THEN {_LIST}[p_partkey % 2 + 1:p_partkey % 2 + p_partkey % 3] END AS s, CASE WHEN p_partkey % 4 > 0 THEN {_LIST}[p_partkey % 3 + 1:p_partkey % 3 + p_partkey % 4] END AS off,
CASE WHEN p_partkey % 5 > 0 THEN {_LIST}[p_partkey % 2 + 1:p_partkey % 2 + p_partkey % 5] END AS ons FROM part)
SELECT k AS p_partkey, s IS NULL OR list_contains(s, b) AS here, NOT coalesce(list_contains(off, b), false) AND (ons IS NULL OR list_contains(ons, b)) AS active FROM k""",
}
