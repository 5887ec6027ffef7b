"""Geology queries: boreholes out of `lineitem`, surfaces out of `supplier`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import header_key, safe_id, source_type
from ..operators import geology as o
from ..operators import validate as v
from ..session import table
from .views import BH_SQL, borehole_rows


def layers(spark, sf):
    """SRC-01, PRJ-19."""
    return o.borehole_layers(borehole_rows(spark, sf)).select("borehole_id", "seq", "layer_id", "material_id", "top", "bottom")


def summary(spark, sf):
    """AGG-21."""
    return o.layer_summary(o.borehole_layers(borehole_rows(spark, sf))).withColumn("thickness", F.round("thickness", 6))


def solids(spark, sf):
    """WIN-10, WIN-12."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("model"), F.col("s_suppkey").alias("surface"), F.col("s_acctbal").alias("z"))
    return o.layer_solids(s).withColumn("thickness", F.round("thickness", 6))


def _samples(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).alias("surface"), k.alias("seq"), (k % 10).cast("double").alias("x"), (F.floor(k / 10) % 10).cast("double").alias("y"), F.col("s_acctbal").alias("z"))


def idw(spark, sf):
    """SPA-01 to SPA-04, GEN-04."""
    grid = spark.range(4).select(F.col("id").alias("surface")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    grid = grid.withColumns({"x": F.col("i") * 2.5, "y": F.col("j") * 2.5})
    return o.idw_grid(_samples(spark, sf), grid).select("surface", "i", "j", F.round("z", 4).alias("z"))


def flags(spark, sf):
    """AGG-26."""
    t = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 9).alias("layer"), (F.col("l_quantity") - F.col("l_suppkey") % 3).alias("thickness"))
    return o.stratigraphy_flags(t, thin=1.5)


def names(spark, sf):
    """FN-01, FN-02, SRC-26."""
    p = table(spark, sf, "part")
    raw = F.concat(F.lit(" "), F.col("p_type"), F.lit("--"), F.col("p_brand"), F.lit("! "))
    return p.select("p_partkey", safe_id(raw).alias("safe"), safe_id(F.col("p_partkey").cast("string"), "bh").alias("key_id"), header_key(raw).alias("header"), source_type(F.lit(" STL-Geology ")).alias("kind"))


def nearest(spark, sf):
    """JOIN-07, JOIN-08, JOIN-28."""
    c = F.col
    a = table(spark, sf, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") % 50).cast("double").alias("x"), c("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    b = table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), (c("s_suppkey") % 50).cast("double").alias("x"), c("s_nationkey").cast("double").alias("y"), F.lit(0.5).alias("z"))
    return o.nearest(a, b, 3.0).select("id", "near", F.round("distance", 6).alias("distance"))


def _issues(spark, sf):
    line, orders, cust = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    return v.report(
        v.orphans(orders, "o_custkey", cust.where("c_custkey % 5 <> 0"), "c_custkey", "unknown_material", target="o_orderkey"),
        v.orphans(line, "l_orderkey", orders.where("o_orderkey % 11 <> 0"), "o_orderkey", "unknown_phase", severity="warning"),
        v.violations(line, F.col("l_quantity") > 1, "thin_layer", "l_orderkey", severity="warning"),
    )


def issues(spark, sf):
    """VAL-01, JOIN-16, JOIN-17, JOIN-30."""
    return _issues(spark, sf)


def gate(spark, sf):
    """VAL-03, AGG-33."""
    return v.gate(_issues(spark, sf))


_ISSUES = """i AS (SELECT 'error' AS severity, 'unknown_material' AS code, o_orderkey::VARCHAR AS target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)
UNION ALL SELECT 'warning', 'unknown_phase', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0)
UNION ALL SELECT 'warning', 'thin_layer', l_orderkey::VARCHAR FROM lineitem WHERE NOT l_quantity > 1)"""
_TEXT = "' ' || p_type || '--' || p_brand || '! '"

QUERIES = {
    "bh_layers": layers, "bh_summary": summary, "geo_solids": solids, "geo_idw": idw, "geo_flags": flags, "text_names": names, "geo_nearest": nearest, "val_issues": issues, "val_gate": gate, "val_issues_all": issues, "val_gate_all": gate,
}
SQL = {
    "bh_layers": f"WITH {BH_SQL} SELECT borehole_id, CAST(row_number() OVER (PARTITION BY borehole_id ORDER BY top DESC, bottom DESC, layer_id, material_id) AS INTEGER) AS seq, layer_id, material_id, top, bottom FROM lay",
    "bh_summary": f"""WITH {BH_SQL} SELECT layer_id, count(DISTINCT borehole_id) AS holes, max(top) AS top, min(bottom) AS bottom, round(avg(top - bottom), 6) AS thickness,
min(material_id) AS material_id, count(DISTINCT material_id) > 1 AS mixed FROM lay GROUP BY layer_id""",
    "geo_solids": """SELECT * FROM (SELECT s_nationkey AS model, s_suppkey AS surface, s_acctbal AS z, lead(s_suppkey) OVER w AS base, lead(s_acctbal) OVER w AS base_z,
round(s_acctbal - lead(s_acctbal) OVER w, 6) AS thickness FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)) WHERE base IS NOT NULL""",
    "geo_idw": """WITH s AS (SELECT s_nationkey % 3 AS surface, s_suppkey AS seq, s_suppkey % 10 AS x, (s_suppkey // 10) % 10 AS y, s_acctbal AS z FROM supplier),
g AS (SELECT a.v AS surface, b.v AS i, c.v AS j FROM range(4) a(v), range(5) b(v), range(5) c(v)),
d AS (SELECT g.surface, i, j, seq, z, (i * 2.5 - x) * (i * 2.5 - x) + (j * 2.5 - y) * (j * 2.5 - y) AS d2 FROM g LEFT JOIN s ON g.surface = s.surface)
SELECT surface, i, j, round(coalesce(arg_min(z, seq) FILTER (WHERE d2 <= 1e-18), sum(z / d2) FILTER (WHERE d2 > 1e-18) / sum(1 / d2) FILTER (WHERE d2 > 1e-18)), 4) AS z FROM d GROUP BY ALL""",
    "geo_flags": """SELECT layer, min(t) AS low, max(t) AS high, CASE WHEN min(t) < -1e-9 THEN 'crossing' WHEN abs(min(t)) <= 1e-9 THEN 'pinch_out' WHEN min(t) < 1.5 THEN 'thin_lens' ELSE 'ok' END AS flag
FROM (SELECT l_suppkey % 9 AS layer, l_quantity - l_suppkey % 3 AS t FROM lineitem) GROUP BY layer""",
    "text_names": f"""SELECT p_partkey, trim(regexp_replace(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS safe, 'bh_' || p_partkey AS key_id,
translate(lower(trim({_TEXT})), ' -', '__') AS header, 'stl_geology' AS kind FROM part""",
    "geo_nearest": """WITH a AS (SELECT c_custkey AS id, c_custkey % 50 AS x, c_nationkey AS y FROM customer), b AS (SELECT s_suppkey AS near, s_suppkey % 50 AS x, s_nationkey AS y FROM supplier),
d AS (SELECT id, near, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 0.25) AS distance FROM a JOIN b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3)
SELECT id, arg_min(near, (distance, near)) AS near, round(min(distance), 6) AS distance FROM d WHERE distance <= 3 GROUP BY id""",
    "val_issues": f"WITH {_ISSUES} SELECT severity, code, count(*) AS issues, min(target) AS first FROM i GROUP BY ALL",
    "val_gate": f"""WITH {_ISSUES} SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'blocked' WHEN count(*) > 0 THEN 'warn' ELSE 'ready' END AS status FROM i""",
}
#: Names of round 2 for the same whole tables.
SQL |= {"val_issues_all": SQL["val_issues"], "val_gate_all": SQL["val_gate"]}
