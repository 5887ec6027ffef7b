"""Layer queries: soil layers and surface grids out of `part`, imported labels on the lattice out of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geology, geometry
from ..operators import layers as o
from ..session import table
from .views import BH_SQL, CELLS_SQL, borehole_rows, cells

_SOIL = """l AS (SELECT p_partkey % 50 AS model, 'layer_' || p_partkey AS layer, -p_size::DOUBLE AS a, (-p_size + p_partkey % 7 - 1)::DOUBLE AS b FROM part),
bo AS (SELECT DISTINCT p_partkey % 60 AS model, (-20 - p_partkey % 60 % 3)::DOUBLE AS z0, CASE WHEN p_partkey % 60 % 20 = 19 THEN (-20 - p_partkey % 60 % 3)::DOUBLE ELSE -5.0 END AS z1 FROM part),
c AS (SELECT model, layer, greatest(least(a, z1), z0) AS ca, greatest(least(b, z1), z0) AS cb FROM l JOIN bo USING (model)),
k AS (SELECT model, layer, least(ca, cb) AS z_min, greatest(ca, cb) AS z_max FROM c WHERE ca <> cb),
s AS (SELECT * FROM k UNION ALL SELECT model, 'soil_layer', z0, CASE WHEN z1 > z0 THEN z1 ELSE z0 + 1 END FROM bo WHERE model NOT IN (SELECT model FROM k)),
n AS (SELECT *, row_number() OVER w AS seq, lag(layer) OVER w AS below FROM s WINDOW w AS (PARTITION BY model ORDER BY z_min, layer))"""


def _soil(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    layers = part.select((k % 50).alias("model"), F.concat(F.lit("layer_"), k.cast("string")).alias("layer"), (-F.col("p_size")).cast("double").alias("a"), (-F.col("p_size") + k % 7 - 1).cast("double").alias("b"))
    m = F.col("model")
    low = (-20 - m % 3).cast("double")
    bounds = part.select((k % 60).alias("model")).distinct().withColumns({"z0": low, "z1": F.when(m % 20 == 19, low).otherwise(-5.0), "x0": F.lit(0.0), "x1": m.cast("double"), "y0": F.lit(1.0), "y1": F.lit(3.0)})
    return o.soil_layers(layers, bounds), bounds


def soil(spark, sf):
    """SRT-02."""
    return _soil(spark, sf)[0].select("model", "seq", "layer", "below", "z_min", "z_max")


def soil_cut(spark, sf):
    """GEN-08."""
    return o.layer_cut_report(_soil(spark, sf)[0], 3, 2)


def soil_cells(spark, sf):
    """GEN-08, PRJ-03: volumes of the cut columns."""
    layers, bounds = _soil(spark, sf)
    c = o.layer_cells(layers, bounds, 3, 2)
    return c.groupBy("model").agg(F.count("*").alias("cells"), F.round(F.sum(geometry.bbox_volume(F.col("pts"))), 6).alias("volume"))


_GRID = """g AS (SELECT p_partkey // 100 AS layer, p_partkey % 10 AS i, p_partkey // 10 % 10 AS j, (p_partkey % 10 * 2)::DOUBLE AS x, (p_partkey // 10 % 10 * 3)::DOUBLE AS y,
(-10 * (p_partkey // 100) + p_size % 5)::DOUBLE AS top, (-10 * (p_partkey // 100) + p_size % 5 - p_size % 4)::DOUBLE AS bottom FROM part)"""
_AROUND = "FROM g a JOIN g b ON b.layer = a.layer AND b.i = a.i + 1 AND b.j = a.j JOIN g c ON c.layer = a.layer AND c.i = a.i + 1 AND c.j = a.j + 1 JOIN g d ON d.layer = a.layer AND d.i = a.i AND d.j = a.j + 1"


def _grid(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    layer, i, j = F.floor(k / 100), k % 10, F.floor(k / 10) % 10
    top = (-10 * layer + n % 5).cast("double")
    return table(spark, sf, "part").select(layer.alias("layer"), i.alias("i"), j.alias("j"), (i * 2).cast("double").alias("x"), (j * 3).cast("double").alias("y"), top.alias("top"), (top - n % 4).alias("bottom"))


def swept(spark, sf):
    """GEN-05."""
    c = o.layered_mesh(_grid(spark, sf), 10, 10)
    return c.select("layer", "i", "j", F.array_join(F.transform("conn", lambda x: x.cast("string")), ",").alias("conn"), "volume")


def triangles(spark, sf):
    """GEN-26, PRJ-06."""
    t = o.grid_triangles(_grid(spark, sf).select(F.col("layer").alias("surface"), "i", "j", "x", "y", F.col("top").alias("z")), 10, 10)
    p = F.col("pts")
    return t.groupBy("surface").agg(F.count("*").alias("triangles"), F.round(F.sum(geometry.triangle_area(p[0], p[1], p[2])), 4).alias("area"))


def columns(spark, sf):
    """GEN-09: columns between interpolated surfaces, each down to the next."""
    k = F.col("s_suppkey")
    samples = table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).alias("surface"), k.alias("seq"), (k % 10).cast("double").alias("x"), (F.floor(k / 10) % 10).cast("double").alias("y"), F.col("s_acctbal").alias("z"))
    ij = spark.range(3).select(F.col("id").alias("surface")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumns({"x": F.col("i") * 2.5, "y": F.col("j") * 2.5})
    z = geology.idw_grid(samples, ij)
    below = z.select((F.col("surface") - 1).alias("surface"), "i", "j", F.col("z").alias("bottom"))
    grid = z.join(below, ["surface", "i", "j"]).select(F.col("surface").alias("layer"), "i", "j", "x", "y", F.col("z").alias("top"), "bottom")
    return o.layered_mesh(grid, 5, 5).groupBy("layer").agg(F.count("*").alias("cells"), F.round(F.sum("volume"), 2).alias("volume"))


def surfaces(spark, sf):
    """AGG-25."""
    lay = geology.borehole_layers(borehole_rows(spark, sf))
    out = o.surface_summary(lay.select(F.col("layer_id").alias("layer"), F.col("borehole_id").alias("hole"), F.col("top").alias("z")))
    return out.withColumn("mean", F.round("mean", 6))


def labels(spark, sf):
    """FN-05, JOIN-25: node labels on the lattice."""
    c = cells(spark, sf)
    nodes = c.select(F.explode("conn").alias("node_id")).distinct()
    marks = nodes.where("node_id % 11 <> 0").select("node_id", F.concat(F.lit("soil_"), (F.floor(F.col("node_id") / 5) % 4).cast("string")).alias("label"))
    edited = table(spark, sf, "nation").where("n_nationkey < 2").select(F.concat(F.lit("soil_"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("material"), (F.col("n_nationkey") * 1000.0).alias("stiffness"))
    own = c.select("cell_id").join(o.cell_labels(c, marks), "cell_id", "left")
    return o.imported_layers(own, edited)


def fields(spark, sf):
    """FLT-14."""
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "vtk_").otherwise(""), "p_type", F.when(F.col("p_partkey") % 3 == 0, " Layer-Id").when(F.col("p_partkey") % 3 == 1, ":Facies").otherwise(""))
    return table(spark, sf, "part").groupBy(o.looks_like_geology(name).alias("geology")).agg(F.count("*").alias("fields"))


QUERIES = {
    "layer_soil": soil, "layer_cut": soil_cut, "layer_cells": soil_cells, "layer_mesh": swept, "layer_triangles": triangles, "layer_columns": columns, "layer_surfaces": surfaces, "layer_imported": labels, "layer_fields": fields,
}
_TOK = "soil|stratum|strata|layer|geology|geo|lithology|formation|material|mat|rock|phase|physical|gmsh|region|domain|zone|group|unit|facies"
SQL = {
    "layer_soil": f"WITH {_SOIL} SELECT model, CAST(seq AS INTEGER) AS seq, layer, below, z_min, z_max FROM n",
    "layer_cut": f"""WITH {_SOIL} SELECT model, count(*) AS layers, count(*) * 6 AS cells, count(below) AS interfaces, min(z_min) AS low, max(z_max) AS high,
(SELECT count(DISTINCT z) * 12 FROM (SELECT z_min AS z FROM n m WHERE m.model = n.model UNION ALL SELECT z_max FROM n m WHERE m.model = n.model)) AS nodes FROM n GROUP BY model""",
    "layer_cells": f"WITH {_SOIL} SELECT model, count(*) * 6 AS cells, round(sum((z_max - z_min) * 2 * CASE WHEN model > 0 THEN model ELSE 1 END), 6) AS volume FROM n GROUP BY model",
    "layer_mesh": f"""WITH {_GRID}, q AS (SELECT a.layer, a.i, a.j, 6 * (greatest(a.top, b.top, c.top, d.top) - least(a.bottom, b.bottom, c.bottom, d.bottom)) AS volume {_AROUND})
SELECT layer, i, j, volume, array_to_string([{", ".join(f"((layer * 2 + {s}) * 10 + j + {b}) * 10 + i + {a}" for s in (1, 0) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))}], ',') AS conn FROM q WHERE volume > 1e-12""",
    "layer_triangles": f"""WITH {_GRID} SELECT a.layer AS surface, count(*) * 2 AS triangles, round(sum(0.5 * sqrt(pow(3 * (b.top - a.top), 2) + pow(2 * (c.top - b.top), 2) + 36)
+ 0.5 * sqrt(pow(3 * (c.top - d.top), 2) + pow(2 * (d.top - a.top), 2) + 36)), 4) AS area {_AROUND} GROUP BY a.layer""",
    "layer_columns": """WITH s AS (SELECT s_nationkey % 3 AS surface, s_suppkey AS seq, s_suppkey % 10 AS x, (s_suppkey // 10) % 10 AS y, s_acctbal AS z FROM supplier),
g AS (SELECT a.v AS surface, b.v AS i, c.v AS j FROM range(3) a(v), range(5) b(v), range(5) c(v)),
d AS (SELECT g.surface, i, j, seq, z, (i * 2.5 - x) * (i * 2.5 - x) + (j * 2.5 - y) * (j * 2.5 - y) AS d2 FROM g JOIN s ON g.surface = s.surface),
f AS (SELECT surface, i, j, coalesce(arg_min(z, seq) FILTER (WHERE d2 <= 1e-18), sum(z / d2) FILTER (WHERE d2 > 1e-18) / sum(1 / d2) FILTER (WHERE d2 > 1e-18)) AS z FROM d GROUP BY ALL),
p AS (SELECT a.surface AS layer, a.i, a.j, a.z AS top, b.z AS bottom FROM f a JOIN f b ON b.surface = a.surface + 1 AND a.i = b.i AND a.j = b.j),
q AS (SELECT c.layer, c.i, c.j, count(*) AS n, max(greatest(p.top, p.bottom)) - min(least(p.top, p.bottom)) AS dz FROM p c JOIN p ON p.layer = c.layer AND p.i - c.i IN (0, 1) AND p.j - c.j IN (0, 1) GROUP BY ALL)
SELECT layer, count(*) AS cells, round(sum(6.25 * dz), 2) AS volume FROM q WHERE n = 4 AND 6.25 * dz > 1e-12 GROUP BY layer""",
    "layer_surfaces": f"""WITH {BH_SQL} SELECT layer_id AS layer, count(*) AS samples, count(DISTINCT borehole_id) AS holes, round(avg(top), 6) AS mean, min(top) AS low, max(top) AS high, count(*) < 2 AS sparse FROM lay GROUP BY layer_id""",
    "layer_imported": f"""WITH {CELLS_SQL}, f AS (SELECT cell_id, unnest(conn) AS n FROM cells), c AS (SELECT cell_id, 'soil_' || (n // 5 % 4) AS label, count(*) AS k FROM f WHERE n % 11 <> 0 GROUP BY ALL),
b AS (SELECT cell_id, arg_min(label, (-k, label)) AS label FROM c GROUP BY cell_id), e AS (SELECT 'soil_' || n_nationkey AS label, n_name AS material, n_nationkey * 1000.0::DOUBLE AS stiffness FROM nation WHERE n_nationkey < 2),
o AS (SELECT coalesce(label, 'unassigned') AS label, count(*) AS cells FROM cells LEFT JOIN b USING (cell_id) GROUP BY 1)
SELECT label, cells, coalesce(material, 'mat_' || label) AS material, coalesce(stiffness, 30000.0::DOUBLE) AS stiffness, material IS NOT NULL AS edited FROM o LEFT JOIN e USING (label)""",
    "layer_fields": f"""SELECT regexp_matches(k, '{_TOK}') AND NOT starts_with(k, 'vtk') AND k NOT IN ('connectivity', 'offsets', 'types') AS geology, count(*) AS fields
FROM (SELECT translate(lower((CASE WHEN p_partkey % 5 = 0 THEN 'vtk_' ELSE '' END) || p_type || CASE p_partkey % 3 WHEN 0 THEN ' Layer-Id' WHEN 1 THEN ':Facies' ELSE '' END), '-: ', '___') AS k FROM part) GROUP BY 1""",
}
