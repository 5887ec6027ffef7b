"""Queries that fill closed surfaces with voxels: boxes with moved corners, each as twelve triangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import voxels as o
from ..operators.tiles import sorted_join
from .views import BOXES_SQL, boxes

SIZE = 0.6
#: The faces of a box of eight corners as triangles.
TRIS = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (3, 6, 2), (3, 7, 6), (0, 4, 7), (0, 7, 3), (1, 2, 6), (1, 6, 5)]
CORNERS = ["x0 y0 z0", "x1 y0 z0", "x1 y1 z0", "x0 y1 z0", "x0 y0 z1", "x1 y0 z1", "x1 y1 z1", "x0 y1 z1"]
_OFF = {"x": (31, 17, 13, 97.0), "y": (29, 23, 11, 89.0), "z": (37, 19, 17, 83.0)}


def surface(spark, sf):
    """Boxes three times as large, each corner moved by arithmetic on the box's id and the corner; of some boxes a triangle is missing."""
    off = lambda k, c: ((F.col("id") * _OFF[k][0] + c * _OFF[k][1]) % _OFF[k][2]) / _OFF[k][3]
    corner = [g.point(*(3 * F.col(e) + off(k, c) for k, e in zip("xyz", names.split(), strict=True))) for c, names in enumerate(CORNERS)]
    parts = F.array(*(F.array(*(corner[i] for i in t)) for t in TRIS))
    t = boxes(spark, sf).select(F.col("id").alias("region"), F.posexplode(parts).alias("tri_id", "pts"))
    return t.where("not (region % 17 = 5 and tri_id = 2)")


_SURFACE = f"""{BOXES_SQL}, c AS (SELECT id AS region, [{", ".join("[" + ", ".join(f"3 * {e} + ((id * {_OFF[k][0]} + {c} * {_OFF[k][1]}) % {_OFF[k][2]}) / {_OFF[k][3]}::DOUBLE" for k, e in zip("xyz", names.split(), strict=True)) + "]" for c, names in enumerate(CORNERS))}] AS c FROM boxes),
t AS (SELECT * FROM (SELECT region, unnest(range(12)) AS tri, unnest([{", ".join("[" + ", ".join(f"c[{i + 1}]" for i in t) + "]" for t in TRIS)}]) AS p FROM c) WHERE NOT (region % 17 = 5 AND tri = 2)),
lo AS (SELECT region, {", ".join(f"min({f}(p[1][{n}], p[2][{n}], p[3][{n}])) AS {k}0" for n, k in ((1, "x"), (2, "y"), (3, "z")) for f in ("least",))}, {", ".join(f"greatest(1, ceil((max(greatest(p[1][{n}], p[2][{n}], p[3][{n}])) - min(least(p[1][{n}], p[2][{n}], p[3][{n}]))) / {SIZE}::DOUBLE))::BIGINT AS n{k}" for n, k in ((1, "x"), (2, "y"), (3, "z")))} FROM t GROUP BY region),
col AS (SELECT *, m % nx AS i, m // nx AS j FROM (SELECT *, unnest(range(nx * ny)) AS m FROM lo)),
pt AS (SELECT region, i, j, nx, ny, nz, z0, x0 + (i + 0.5) * {SIZE}::DOUBLE AS x, y0 + (j + 0.5) * {SIZE}::DOUBLE AS y FROM col),
s AS (SELECT pt.*, p, (p[2][1] - p[1][1]) * (y - p[1][2]) - (p[2][2] - p[1][2]) * (x - p[1][1]) AS s1, (p[3][1] - p[2][1]) * (y - p[2][2]) - (p[3][2] - p[2][2]) * (x - p[2][1]) AS s2,
(p[1][1] - p[3][1]) * (y - p[3][2]) - (p[1][2] - p[3][2]) * (x - p[3][1]) AS s3 FROM pt JOIN t USING (region)),
z AS (SELECT *, (s2 * p[1][3] + s3 * p[2][3] + s1 * p[3][3]) / (s1 + s2 + s3) AS z FROM s WHERE (s1 > 0 AND s2 > 0 AND s3 > 0) OR (s1 < 0 AND s2 < 0 AND s3 < 0)),
l AS (SELECT region, i, j, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(z0) AS z0, list(z ORDER BY z) AS zs FROM z GROUP BY region, i, j),
v AS (SELECT region, i, j, nx, ny, k FROM (SELECT *, unnest(range(nz)) AS k FROM l) WHERE len(list_filter(zs, lambda q: q < z0 + (k + 0.5) * {SIZE}::DOUBLE)) % 2 = 1
AND (len(zs) % 2 = 0 OR len(list_filter(zs, lambda q: q < z0 + (k + 0.5) * {SIZE}::DOUBLE)) < len(zs)))"""


def report(spark, sf):
    """GEN-20: per box, its lattice, the voxels inside and the columns that meet a hole."""
    out = o.voxel_report(surface(spark, sf), size=SIZE)
    return out.select("region", "nx", "ny", "nz", "voxels", "open", "status", F.round("volume", 6).alias("volume"))


def filled(spark, sf):
    """GEN-20, GEN-10: every voxel that lies inside."""
    t = surface(spark, sf)
    return o.inside(t, o.lattices(t, size=SIZE))[0]


def volume_mesh(spark, sf):
    """GEN-10, GEN-20: hexahedra of the voxels with shared nodes."""
    t = surface(spark, sf)
    own = o.lattices(t, size=SIZE)
    cells, nodes = o.voxel_mesh(o.inside(t, own)[0], own)
    n = nodes.groupBy("region").agg(F.count("*").alias("nodes"), F.round(F.sum("z"), 4).alias("z"))
    return cells.groupBy("region").agg(F.count("*").alias("cells"), F.sum("cell_id").alias("ids")).join(sorted_join(n), "region")


QUERIES = {"voxel_report": report, "voxel_filled": filled, "voxel_mesh": volume_mesh}
SQL = {
    "voxel_report": f"""WITH {_SURFACE}, a AS (SELECT region, count(*) AS voxels FROM v GROUP BY region), b AS (SELECT region, count(*) AS open FROM l WHERE len(zs) % 2 = 1 GROUP BY region)
SELECT region, nx, ny, nz, coalesce(voxels, 0) AS voxels, coalesce(open, 0) AS open, CASE WHEN coalesce(voxels, 0) = 0 THEN 'empty' WHEN coalesce(open, 0) > 0 THEN 'open' ELSE 'ok' END AS status, round(coalesce(voxels, 0) * pow({SIZE}::DOUBLE, 3), 6) AS volume
FROM lo LEFT JOIN a USING (region) LEFT JOIN b USING (region)""",
    "voxel_filled": f"WITH {_SURFACE} SELECT region, i, j, k FROM v",
    "voxel_mesh": f"""WITH {_SURFACE}, n AS (SELECT DISTINCT region, i + di AS i, j + dj AS j, k + dk AS k FROM v, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj), (SELECT unnest([0, 1]) AS dk)),
m AS (SELECT region, count(*) AS nodes, round(sum(z0 + k * {SIZE}::DOUBLE), 4) AS z FROM n JOIN lo USING (region) GROUP BY region)
SELECT region, cells, ids, nodes, z FROM (SELECT region, count(*) AS cells, CAST(sum((k * ny + j) * nx + i) AS BIGINT) AS ids FROM v GROUP BY region) JOIN m USING (region)""",
}
