"""Queries on faces and cell shapes: a lattice whose nodes are moved a little, and boxes as triangle soups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faces as o
from ..operators import geometry as g
from ..operators import mesh
from ..operators import quality as q
from ..session import table
from .views import BOXES_SQL, CELLS_SQL, FACES_SQL, NX, NY, boxes, cells


def _moved(c):
    """Lattice nodes, each moved by arithmetic on its id."""
    n = F.col("node_id")
    off = lambda a, m: ((n * a) % m - F.floor(F.lit(m) / 2)) / 40.0
    return mesh.lattice_nodes(c, NX, NY).withColumns({"x": F.col("x") + off(7919, 13), "y": F.col("y") + off(104729, 11), "z": F.col("z") + off(1299709, 17)})


def _at(n: str) -> tuple[str, str, str]:
    return f"({n} % 21 + ({n} * 7919 % 13 - 6) / 40.0::DOUBLE)", f"({n} // 21 % 21 + ({n} * 104729 % 11 - 5) / 40.0::DOUBLE)", f"({n} // 441 + ({n} * 1299709 % 17 - 8) / 40.0::DOUBLE)"


def _points(source: str, count: int, rest: str) -> str:
    cols = ", ".join(f"{e} AS {k}{i}" for i in range(count) for k, e in zip("xyz", _at(f"conn[{i + 1}]"), strict=True))
    return f"SELECT {rest}, {cols} FROM {source}"


def _tets(parts: list) -> str:
    return "[" + ", ".join("[" + ", ".join(f"conn[{i + 1}]" for i in t) + "]" for t in parts) + "]"


def _cross(u: str, v: str, a: int, b: int, c: int) -> str:
    """One component of (b - a) x (c - a)."""
    d = lambda k, i: f"({k}{i} - {k}{a})"
    return f"({d(u, b)} * {d(v, c)} - {d(v, b)} * {d(u, c)})"


def _normals(faces) -> str:
    return ", ".join(f"{_cross(u, v, *f)} AS n{k}{i}" for i, f in enumerate(faces) for k, (u, v) in zip("xyz", (("y", "z"), ("z", "x"), ("x", "y")), strict=True))


def _edge(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"({k}{a} - {k}{b}) * ({k}{a} - {k}{b})" for k in "xyz") + ")"


_VOLUME = "((" + " + ".join(f"{_cross(u, v, 0, 1, 2)} * ({k}3 - {k}0)" for k, (u, v) in zip("xyz", (("y", "z"), ("z", "x"), ("x", "y")), strict=True)) + ") / 6)"
_LEN = [f"sqrt(nx{i} * nx{i} + ny{i} * ny{i} + nz{i} * nz{i})" for i in range(4)]
_ANGLE = ", ".join(f"180 - degrees(acos(greatest(-1, least(1, (nx{i} * nx{j} + ny{i} * ny{j} + nz{i} * nz{j}) / (l{i} * l{j})))))" for i, j in q.EDGES)
_QUALITY = f"""{CELLS_SQL}, t AS (SELECT region, unnest({_tets(mesh.HEX_TETS)}) AS conn FROM cells), p AS ({_points("t", 4, "region")}),
n AS (SELECT *, {_VOLUME} AS v, [{", ".join(_edge(a, b) for a, b in q.EDGES)}] AS e, {_normals(q.FACES)} FROM p), l AS (SELECT *, {", ".join(f"{x} AS l{i}" for i, x in enumerate(_LEN))} FROM n),
a AS (SELECT region, v, greatest(list_max(e) / list_min(e), pow(list_max(e), 3) / abs(v) / 8) AS aspect, [{_ANGLE}] AS angles FROM l),
f AS (SELECT region, v, aspect, aspect >= 6 AS sliver, v <= 0 AS inverted, abs(v) <= greatest((SELECT min(abs(v)) FROM a) * 1e-6, 1e-14) AS tiny, list_min(angles) <= 30 OR list_max(angles) >= 175 AS poor FROM a)"""
_SUMMARY = """count(*) AS cells, count(*) FILTER (WHERE sliver) AS sliver, count(*) FILTER (WHERE inverted) AS inverted, count(*) FILTER (WHERE tiny) AS tiny, count(*) FILTER (WHERE poor) AS poor,
count(*) FILTER (WHERE sliver OR inverted OR tiny OR poor) AS bad, round(min(abs(v)), 6) AS least_volume, round(max(abs(v)), 6) AS greatest_volume, round(avg(abs(v)), 6) AS mean_volume,
round(min(aspect), 5) AS least_aspect, round(max(aspect), 5) AS greatest_aspect, round(avg(aspect), 5) AS mean_aspect"""


def tet_shapes(spark, sf):
    """AGG-09, SET-10, PRJ-02, PRJ-12, PRJ-13."""
    c = cells(spark, sf)
    out = q.quality_summary(q.tet_quality(mesh.split_with_points(c, _moved(c), mesh.hex_to_tets), None, sliver=6.0, angle=30.0), "region")
    return out.select("region", "cells", "sliver", "inverted", "tiny", "poor", "bad", *(F.round(f"{n}_{c}", d).alias(f"{n}_{c}") for c, d in (("volume", 6), ("aspect", 5)) for n in ("least", "greatest", "mean")))


_HEX = f"{CELLS_SQL}, p AS ({_points('cells', 8, 'cell_id, region')}), m AS (SELECT cell_id, region, " + " * ".join(
    f"(greatest({', '.join(f'{k}{i}' for i in range(8))}) - least({', '.join(f'{k}{i}' for i in range(8))}))" for k in "xyz"
) + f" AS measure, [{', '.join(_edge(a, b) for a in range(8) for b in range(a))}] AS d FROM p), h AS (SELECT *, list_max(d) / list_min(d) AS aspect FROM m)"


def hex_shapes(spark, sf):
    """AGG-07, AGG-10, FLT-10, PRJ-03, PRJ-11: on moved nodes."""
    c = cells(spark, sf)
    quality = mesh.cell_quality(c, _moved(c), most_aspect=2.5)
    out = quality.groupBy("region").agg(F.count("*").alias("cells"), F.min("measure").alias("least"), F.max("aspect").alias("aspect"), F.avg("quality").alias("quality"), F.count_if("bad").alias("bad"))
    return out.select("region", "cells", "bad", *(F.round(k, 6).alias(k) for k in ("least", "aspect", "quality")))


def gate(spark, sf):
    """AGG-08."""
    c = cells(spark, sf)
    out = q.quality_gate(mesh.cell_quality(c, _moved(c)), least=1.5, most_aspect=2.6)
    return out.select("cells", "bad", "passed", F.round("least", 6).alias("least"), F.round("aspect", 6).alias("aspect"))


def refine(spark, sf):
    """GEN-11, GEN-33: flat hexahedra are cut up, and those with hardly any volume go."""
    c = cells(spark, sf)
    bad = mesh.cell_quality(c, _moved(c)).where("measure < 2.0").select("cell_id", "measure", F.lit(1.8).alias("least"))
    out = q.refined(c, bad, F.col("cell_id") + 10_000_000)
    return out.groupBy("region", "cell_type").agg(F.count("*").alias("cells"), F.sum(F.size("conn")).alias("corners"))


def six(spark, sf):
    """GEN-22, GEN-23, PRJ-01: six tetrahedra a hexahedron, by signed volume."""
    c = cells(spark, sf)
    t = mesh.split_with_points(c, _moved(c), q.hex_to_six)
    v = g.signed_tet_volume(F.col("pts"))
    return t.groupBy("region").agg(F.count("*").alias("tets"), F.round(F.sum(v), 5).alias("volume"), F.count_if(v <= 0).alias("inverted"))


def _triangles(spark, sf, points=True):
    """Faces of tetrahedra as surface triangles of five sets, some turned round and some of no cell; with their points, where these are wanted."""
    c = cells(spark, sf)
    tets = mesh.hex_to_tets(c)
    k, n = F.col("cell_id"), F.col("conn")
    t = tets.where("cell_id % 3 = 0").select(
        k.alias("tri_id"), (k % 5).alias("set"),
        F.array(n[0], F.when(k % 35 == 0, n[3]).otherwise(n[1]), F.when(k % 35 == 0, n[1]).otherwise(n[3])).alias("face"),
    )
    odd = F.when(F.col("tri_id") % 33 == 0, F.array(F.col("face")[0], F.col("face")[1], F.col("face")[2] + 1_000_000_000)).otherwise(F.col("face"))
    own = t.select("tri_id", "set", odd.alias("conn"))
    if points:
        pts = mesh.with_points(t.select(F.col("tri_id").alias("cell_id"), F.col("face").alias("conn")), _moved(c)).select(F.col("cell_id").alias("tri_id"), "pts")
        own = own.join(pts, "tri_id")
    return o.face_owners(own, tets)


_OWNED = f"""{CELLS_SQL}, t AS (SELECT cell_id * 5 + unnest(range(5)) AS id, region, unnest({_tets(mesh.HEX_TETS)}) AS conn FROM cells),
u AS (SELECT id, region, unnest(range(4)) AS local, unnest([{", ".join("list_sort([" + ", ".join(f"conn[{i + 1}]" for i in f) + "])" for f in mesh.FACES["tet4"])}]) AS key FROM t),
r AS (SELECT id AS tri_id, id % 5 AS set, CASE WHEN id % 35 = 0 THEN [conn[1], conn[4], conn[2]] ELSE [conn[1], conn[2], conn[4]] END AS conn FROM t WHERE id % 3 = 0),
k AS (SELECT *, list_sort(CASE WHEN tri_id % 33 = 0 THEN [conn[1], conn[2], conn[3] + 1000000000] ELSE conn END) AS key FROM r),
w AS (SELECT key, list(struct_pack(id := id, local := local, region := region) ORDER BY id, local) AS uses FROM u GROUP BY key),
o AS (SELECT k.*, uses[1] AS owner, uses[2] AS neighbour FROM k LEFT JOIN w USING (key)),
p AS ({_points("o", 3, "tri_id, set, owner, neighbour")}), n AS (SELECT *, {_normals([(0, 1, 2)])} FROM p),
m AS (SELECT *, sqrt(nx0 * nx0 + ny0 * ny0 + nz0 * nz0) AS l FROM n),
f AS (SELECT set, arg_min(nx0 / l, tri_id) AS fx, arg_min(ny0 / l, tri_id) AS fy, arg_min(nz0 / l, tri_id) AS fz FROM m GROUP BY set)"""


def owners(spark, sf):
    """JOIN-09."""
    return _triangles(spark, sf, points=False).select("tri_id", F.col("owner.cell_id").alias("owner"), F.col("owner.local").alias("face"), F.col("neighbour.cell_id").alias("neighbour"))


def sets(spark, sf):
    """AGG-16, PRJ-07."""
    out = o.face_sets(_triangles(spark, sf))
    return out.select("set", "faces", "matched", "internal", "owner_region", *(F.round(k, 5).alias(k) for k in ("area", "nx", "ny", "nz", "consistency")))


def bindings(spark, sf):
    """JOIN-23."""
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("binding"), F.when(F.col("o_orderkey") % 3 == 0, "interface").when(F.col("o_orderkey") % 3 == 1, "load").otherwise("condition").alias("kind"), (F.col("o_custkey") % 7).alias("target"))
    return o.bind_face_sets(b, o.set_counts(_triangles(spark, sf, points=False))).groupBy("kind", "status").agg(F.count("*").alias("bindings"), F.sum("faces").alias("faces"))


def names(spark, sf):
    """FN-08, PRJ-05: boundary faces by the plane that their centre lies on."""
    c = cells(spark, sf)
    n = mesh.lattice_nodes(c, NX, NY)
    b = mesh.face_uses(c).where("kind = 'boundary'").select(F.xxhash64("face_key").alias("cell_id"), F.col("face_key").alias("conn"))
    box = F.broadcast(n.agg(*(f(k).alias(f"{k}{s}") for k in "xyz" for s, f in ((0, F.min), (1, F.max)))))  # one row
    mid = g.centroid(F.col("pts"))
    return mesh.with_points(b, n).join(box).groupBy(o.boundary_name(mid["x"], mid["y"], mid["z"]).alias("name")).agg(F.count("*").alias("faces"))


_TRIS = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (3, 6, 2), (3, 7, 6), (0, 4, 7), (0, 7, 3), (1, 2, 6), (1, 6, 5)]
_CORNER = ["x0 y0 z0", "x1 y0 z0", "x1 y1 z0", "x0 y1 z0", "x0 y0 z1", "x1 y0 z1", "x1 y1 z1", "x0 y1 z1"]


def _soup(spark, sf):
    """Every box as twelve triangles; of some boxes one is missing, turned round, or has no area, and some are inside out."""
    b = boxes(spark, sf)
    k = F.col("id")
    corner = [g.point(*map(F.col, c.split())) for c in _CORNER]
    parts = F.array(*(F.array(*(corner[i] for i in t)) for t in _TRIS))
    t = b.select(k.alias("region"), F.posexplode(parts).alias("part", "p")).select("region", (F.col("region") * 12 + F.col("part")).alias("tri_id"), "part", "p")
    p, r = F.col("p"), F.col("region")
    turned = (r % 5 == 1) | ((r % 7 == 2) & (F.col("part") == 3))
    flat = (r % 11 == 4) & (F.col("part") == 5)
    pts = F.when(flat, F.array(p[0], p[0], p[1])).when(turned, F.array(p[0], p[2], p[1])).otherwise(p)
    return t.where(~((r % 13 == 6) & (F.col("part") == 7))).select("region", "tri_id", pts.alias("pts"))


_SOUP = f"""{BOXES_SQL}, c AS (SELECT id AS region, [{", ".join("[" + ", ".join(c.split()) + "]" for c in _CORNER)}] AS c FROM boxes),
x AS (SELECT region, unnest(range(12)) AS part, unnest([{", ".join("[" + ", ".join(f"c[{i + 1}]" for i in t) + "]" for t in _TRIS)}]) AS p FROM c),
y AS (SELECT region, CASE WHEN region % 11 = 4 AND part = 5 THEN [p[1], p[1], p[2]] WHEN region % 5 = 1 OR (region % 7 = 2 AND part = 3) THEN [p[1], p[3], p[2]] ELSE p END AS p FROM x WHERE NOT (region % 13 = 6 AND part = 7)),
z AS (SELECT region, p, 0.5 * sqrt(pow((p[2][2] - p[1][2]) * (p[3][3] - p[1][3]) - (p[2][3] - p[1][3]) * (p[3][2] - p[1][2]), 2) + pow((p[2][3] - p[1][3]) * (p[3][1] - p[1][1]) - (p[2][1] - p[1][1]) * (p[3][3] - p[1][3]), 2)
 + pow((p[2][1] - p[1][1]) * (p[3][2] - p[1][2]) - (p[2][2] - p[1][2]) * (p[3][1] - p[1][1]), 2)) AS area FROM y),
e AS (SELECT region, unnest([[p[1], p[2]], [p[2], p[3]], [p[3], p[1]]]) AS e FROM z WHERE area > 1e-14), u AS (SELECT region, list_sort(e) AS k, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT region, count(*) FILTER (WHERE n = 1) AS open_edges, count(*) FILTER (WHERE n > 2) AS busy_edges FROM u GROUP BY region),
n AS (SELECT region, count(DISTINCT q) AS corners FROM (SELECT region, unnest(p) AS q FROM z) GROUP BY region),
t AS (SELECT region, count(*) AS triangles, count(*) FILTER (WHERE area <= 1e-14) AS degenerate, round(sum(area), 6) AS area FROM z GROUP BY region),
j AS (SELECT *, open_edges = 0 AND busy_edges = 0 AND triangles > degenerate AS closed FROM t JOIN n USING (region) JOIN s USING (region)),
ve AS (SELECT region, unnest([[p[1], p[2]], [p[2], p[3]], [p[3], p[1]]]) AS e FROM z), vu AS (SELECT region, list_sort(e) AS k, count(*) AS n, count(*) FILTER (WHERE e[1] < e[2]) AS up FROM ve GROUP BY ALL),
vs AS (SELECT region, bool_and(n = 2) AS closed, count(*) FILTER (WHERE n = 2 AND up <> 1) AS turned FROM vu GROUP BY region),
vv AS (SELECT region, sum(p[1][1] * (p[2][2] * p[3][3] - p[2][3] * p[3][2]) + p[1][2] * (p[2][3] * p[3][1] - p[2][1] * p[3][3]) + p[1][3] * (p[2][1] * p[3][2] - p[2][2] * p[3][1])) / 6 AS volume FROM z GROUP BY region)"""


def repair(spark, sf):
    """VAL-05, VAL-08, AGG-04, AGG-06, SET-06."""
    return o.surface_repair(_soup(spark, sf)).withColumn("area", F.round("area", 6))


def orientation(spark, sf):
    """SET-07."""
    return o.oriented(_soup(spark, sf)).withColumn("volume", F.round("volume", 5) + F.lit(0.0))


def solids(spark, sf):
    """GEN-21."""
    return o.closed_to_tets(_soup(spark, sf)).withColumn("volume", F.round("volume", 5))


QUERIES = {
    "face_tet_shapes": tet_shapes, "face_hex_shapes": hex_shapes, "face_gate": gate, "face_refined": refine, "face_six_tets": six, "face_owners": owners, "face_sets": sets, "face_bindings": bindings,
    "face_names": names, "face_repair": repair, "face_orientation": orientation, "face_closed_tets": solids,
}
SQL = {
    "face_tet_shapes": f"WITH {_QUALITY} SELECT region, {_SUMMARY} FROM f GROUP BY region",
    "face_hex_shapes": f"""WITH {_HEX} SELECT region, count(*) AS cells, round(min(measure), 6) AS least, round(max(aspect), 6) AS aspect, round(avg(1 / aspect), 6) AS quality, count(*) FILTER (WHERE measure <= 1e-12 OR aspect > 2.5) AS bad FROM h GROUP BY region""",
    "face_gate": f"WITH {_HEX} SELECT count(*) AS cells, round(min(measure), 6) AS least, round(max(aspect), 6) AS aspect, count(*) FILTER (WHERE measure <= 1.5 OR aspect > 2.6) AS bad, count(*) FILTER (WHERE measure <= 1.5 OR aspect > 2.6) = 0 AS passed FROM h",
    "face_refined": f"""WITH {_HEX} SELECT region, CASE WHEN measure < 2.0 THEN 'tet4' ELSE 'hex8' END AS cell_type, CAST(sum(CASE WHEN measure < 2.0 THEN 5 ELSE 1 END) AS BIGINT) AS cells, CAST(sum(CASE WHEN measure < 2.0 THEN 20 ELSE 8 END) AS BIGINT) AS corners
FROM h WHERE measure >= 2.0 OR measure > 1.8 GROUP BY ALL""",
    "face_six_tets": f"WITH {CELLS_SQL}, t AS (SELECT region, unnest({_tets(q.HEX_TETS6)}) AS conn FROM cells), p AS ({_points('t', 4, 'region')}) SELECT region, count(*) AS tets, round(sum({_VOLUME}), 5) AS volume, count(*) FILTER (WHERE {_VOLUME} <= 0) AS inverted FROM p GROUP BY region",
    "face_owners": f"WITH {_OWNED} SELECT tri_id, owner.id AS owner, CAST(owner.local AS INTEGER) AS face, neighbour.id AS neighbour FROM o",
    "face_sets": f"""WITH {_OWNED} SELECT set, count(*) AS faces, count(owner) AS matched, count(neighbour) AS internal, arg_min(owner.region, tri_id) AS owner_region, round(sum(l / 2), 5) AS area, round(avg(nx0 / l), 5) AS nx, round(avg(ny0 / l), 5) AS ny,
round(avg(nz0 / l), 5) AS nz, round(avg(CASE WHEN (nx0 * fx + ny0 * fy + nz0 * fz) / l >= -0.2 THEN 1.0::DOUBLE ELSE 0 END), 5) AS consistency FROM m JOIN f USING (set) GROUP BY set""",
    "face_bindings": f"""WITH {_OWNED}, g AS (SELECT set, count(*) AS faces, count(owner) AS matched, count(neighbour) AS internal FROM m GROUP BY set),
b AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'load' ELSE 'condition' END AS kind, o_custkey % 7 AS target FROM orders),
j AS (SELECT kind, coalesce(faces, 0) AS faces, CASE WHEN faces IS NULL THEN 'unknown' WHEN matched > 0 AND (kind <> 'interface' OR internal = matched) THEN 'bound' WHEN kind = 'interface' THEN 'one_sided' ELSE 'unmatched' END AS status FROM b LEFT JOIN g ON target = set)
SELECT kind, status, count(*) AS bindings, CAST(sum(faces) AS BIGINT) AS faces FROM j GROUP BY ALL""",
    "face_names": f"""WITH {FACES_SQL}, b AS (SELECT list_avg([n % 21 for n in face_key]) AS x, list_avg([n // 21 % 21 for n in face_key]) AS y, list_avg([n // 441 for n in face_key]) AS z FROM kinds WHERE kind = 'boundary'),
u AS (SELECT DISTINCT unnest(conn) AS n FROM cells), m AS (SELECT min(n % 21) AS x0, max(n % 21) AS x1, min(n // 21 % 21) AS y0, max(n // 21 % 21) AS y1, min(n // 441) AS z0, max(n // 441) AS z1 FROM u)
SELECT CASE WHEN x = x0 THEN 'xmin' WHEN x = x1 THEN 'xmax' WHEN y = y0 THEN 'ymin' WHEN y = y1 THEN 'ymax' WHEN z = z0 THEN 'zmin' WHEN z = z1 THEN 'zmax' ELSE 'external' END AS name, count(*) AS faces FROM b, m GROUP BY 1""",
    "face_repair": f"WITH {_SOUP} SELECT region, triangles, degenerate, area, corners, open_edges, busy_edges, triangles * 3 - corners AS repeated, closed, closed AND corners IN (4, 8) AS conformal FROM j",
    "face_orientation": f"WITH {_SOUP} SELECT region, round(volume, 5) + 0.0 AS volume, closed, turned, closed AND volume < 0 AS flip FROM vv JOIN vs USING (region)",
    "face_closed_tets": f"WITH {_SOUP} SELECT region, CASE corners WHEN 4 THEN 1 ELSE 5 END AS tets, round(abs(volume), 5) AS volume FROM j JOIN vv USING (region) WHERE closed AND corners IN (4, 8)",
}
