"""Queries on shapes, outlines, selectors and stage states over boxes, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import physics as p
from ..operators import shapes as o
from ..operators import stages as st
from ..operators import topology as t
from ..session import table
from .views import BOXES_SQL, STRESS_SQL, boxes, stress


def cuts(spark, sf):
    """GEN-13, SRT-03, SPA-05, PRJ-08, PRJ-09: an upright plane across every other box, a level one through the rest."""
    k = F.col("id")
    even = k % 2 == 0
    plane = {"px": F.col("x0") + (k % 7) / 4, "py": F.col("y0") + 0.5, "pz": F.col("z0") + (k % 5) / 4, "nx": even.cast("double"), "ny": even.cast("double"), "nz": (~even).cast("double")}
    out = o.plane_cut(boxes(spark, sf).withColumns(plane))
    return out.select("id", F.coalesce(F.size("polygon"), F.lit(0)).alias("points"), F.round(F.coalesce(g.polygon_area(F.col("polygon")), F.lit(0.0)), 6).alias("area"))


def _outlines(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("outline"), e.alias("seq"), (e * 7919 % 101).cast("double").alias("x"), (e * 104729 % 97).cast("double").alias("y"))


_OUT = "p AS (SELECT user_id AS outline, event_id AS seq, (event_id * 7919 % 101)::DOUBLE AS x, (event_id * 104729 % 97)::DOUBLE AS y FROM events)"
_RING = f"""{_OUT}, r AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY outline ORDER BY seq)) AS bx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY outline ORDER BY seq)) AS by_,
coalesce(lag(x) OVER w, last(x) OVER (PARTITION BY outline ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cx, coalesce(lag(y) OVER w, last(y) OVER (PARTITION BY outline ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cy,
row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY outline ORDER BY seq))"""


def outlines(spark, sf):
    """GRA-06, PRJ-20, PRJ-21, SPA-07."""
    return o.outline_checks(_outlines(spark, sf))


def offsets(spark, sf):
    """GEN-34."""
    return o.offset_outline(_outlines(spark, sf), 1.5).select("outline", "seq", F.round("ox", 5).alias("ox"), F.round("oy", 5).alias("oy"))


def panels(spark, sf):
    """GEN-15."""
    return o.panels(_outlines(spark, sf).withColumnRenamed("outline", "line"), -4.0, 2.0).groupBy("line").agg(F.count("*").alias("panels"), F.round(F.sum("length"), 5).alias("length"), F.round(F.sum("area"), 5).alias("area"))


def polygon_boxes(spark, sf):
    """GEN-18."""
    return o.polygon_box(_outlines(spark, sf))


def moved(spark, sf):
    """SRC-18, SRC-19, PRJ-24, PRJ-16, PRJ-17, PRJ-18: boxes scaled, turned and moved."""
    k = F.col("id")
    out = boxes(spark, sf).withColumns(o.transformed(F.lit(2.0), (k % 12 * 30).cast("double"), {"x": F.lit(1.0), "y": F.lit(-2.0), "z": (k % 3).cast("double")}))
    return out.select("id", *(F.round(F.col(f"{a}{s}"), 6).alias(f"{a}{s}") + F.lit(0.0) for a in "xyz" for s in (0, 1))).toDF("id", "x0", "x1", "y0", "y1", "z0", "z1")


def adjacent(spark, sf):
    """SPA-10: upper x faces of every third box against all boxes."""
    b = boxes(spark, sf)
    s = b.where("id % 3 = 0").withColumns({"x0": F.col("x1"), "region": F.when(F.col("id") % 2 == 0, F.col("region"))})
    return o.adjacent_volumes(s, b)


def kinds(spark, sf):
    """PRJ-25, PRJ-26, FLT-12, FLT-13: faces by boundary type and role, and their volumes."""
    f = t.box_faces(boxes(spark, sf))
    k = F.col("id")
    role = F.get(F.array(*map(F.lit, ("soil", "wall", "Horizontal cut", " ", "rock"))), (k % 5).cast("int"))
    kind = o.boundary_type({"label": F.col("label"), "role": F.lower(role), "boundary": k % 4 == 0})
    sem = o.semantic_role(F.when(k % 3 == 0, F.lit(" ")), role)
    low = F.trim(F.lower(role))
    soil = o.is_soil_volume(low, F.when(k % 7 == 0, F.lit("csv")), k % 11 == 0, F.when(k % 13 > 0, F.col("at")))
    return f.groupBy(kind.alias("kind"), sem.alias("role"), soil.alias("soil"), o.is_cutter(low, k % 11 == 0).alias("cutter"), o.pickable(k % 2 == 0, k % 3 == 0).alias("pickable")).agg(F.count("*").alias("faces"))


def chosen(spark, sf):
    """FLT-01, SET-11."""
    c = F.col
    a = table(spark, sf, "supplier").where("s_acctbal > 5000").select((c("s_suppkey") % 30).alias("name"), c("s_suppkey").alias("seq"))
    b = table(spark, sf, "customer").select((c("c_custkey") % 45).alias("name"), c("c_custkey").alias("seq"))
    return o.selected_regions(a, b, table(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("name"), c("n_nationkey").cast("long").alias("seq")))


def meshed(spark, sf):
    """FLT-03: with materials for some regions, and with none."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("region"))
    m = table(spark, sf, "part").where("p_size > 47").select(F.col("p_brand").alias("region"))
    some, none = o.meshing_objects(p, m), o.meshing_objects(p, m.where("region is null"))
    return some.agg(F.count("*").alias("objects"), F.sum("p_partkey").alias("keys")).withColumn("bound", F.lit("some")).union(none.agg(F.count("*"), F.sum("p_partkey")).withColumn("bound", F.lit("none")))


def lists(spark, sf):
    """FN-17, SET-13, MUT-15, FLT-07, MUT-13."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    v = o.fixed_length(F.when(k % 6 > 0, F.slice(F.array(F.lit("1.5"), F.lit("x"), F.col("p_size").cast("string")), 1, (k % 4).cast("int"))), 3, -1.0)
    few = lambda m, n: F.when(k % m > 0, F.slice(F.array(*map(F.lit, ("a", "b", "c", "d"))), (k % n + 1).cast("int"), (k % m).cast("int")))
    shared = st.shared_stages(few(3, 2), few(4, 3))
    snap = st.snapshot(F.array(*map(F.lit, ("d", "c", "a", "b"))), few(3, 2), few(4, 3))
    rows = part.select(k, F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("values"), F.coalesce(F.array_join(F.array_sort(shared), ","), F.lit("*")).alias("shared"), F.array_join(snap, ",").alias("snapshot"), st.without_results(F.concat(F.lit("max_"), F.when(k % 3 == 0, "pore").otherwise("porous"), F.lit("_u"))).alias("kept"), F.when(k % 9 > 0, "s1").alias("stage"))
    return st.results_for(rows, F.when(F.col("p_partkey") % 2 == 0, F.lit("s1")))


def states(spark, sf):
    """WIN-02, WIN-05: in stage 3 everything is taken away."""
    c = F.col
    e = table(spark, sf, "events")
    regions = e.select((c("user_id") % 40).alias("region")).distinct()
    stages = spark.range(1, 9).select(c("id").alias("stage"), c("id").alias("seq"))
    said = e.select((c("event_id") % 8 + 1).alias("stage"), (c("user_id") % 40).alias("region"), F.get(F.array(*map(F.lit, st.STATEMENTS)), (F.floor(c("event_id") / 8) % 5).cast("int")).alias("kind"), c("value"), c("event_id"))
    active = F.when(c("kind") == "map", c("event_id") % 3 == 0).otherwise(c("kind").isin("activate", "action_activate"))
    said = said.groupBy("stage", "region", "kind").agg(F.bool_and(active).alias("active")).where("stage <> 3")
    said = said.union(regions.select(F.lit(3).cast("long"), "region", F.lit("action_deactivate"), F.lit(False)))
    out = st.stage_states(regions, stages, said)
    return out.select("stage", "region", "is_active")


def principal(spark, sf):
    """FN-13, FN-14: eigenvalues and cone constants as numbers."""
    from ..operators import physics as p
    s = stress(spark, sf)
    a, b, c = p.principal_stresses()
    alpha, k = p.drucker_prager(F.col("cohesion"), F.col("phi"))
    names = {"a": a, "b": b, "c": c, "alpha": alpha, "k": k}
    return s.groupBy((F.col("l_partkey") % 50).alias("material")).agg(*(F.round(F.avg(v), 4).alias(n) for n, v in names.items()))


QUERIES = {
    "shape_cuts": cuts, "shape_outlines": outlines, "shape_offsets": offsets, "shape_panels": panels, "shape_boxes": polygon_boxes, "shape_moved": moved, "shape_adjacent": adjacent, "shape_kinds": kinds,
    "pick_regions": chosen, "pick_meshed": meshed, "pick_lists": lists, "stage_states": states, "state_eigenvalues": principal,
}


def _moved_sql() -> str:
    rad = "radians(id % 12 * 30)"
    flat = [(f"2 * x{a}", f"2 * y{b}") for a in (0, 1) for b in (0, 1)]
    xs, ys = [f"({x}) * cos({rad}) - ({y}) * sin({rad})" for x, y in flat], [f"({x}) * sin({rad}) + ({y}) * cos({rad})" for x, y in flat]
    cols = ", ".join(f"round({f}({', '.join(v)}) + {m}, 6) + 0.0 AS {k}{s}" for k, v, m in (("x", xs, "1"), ("y", ys, "-2")) for s, f in ((0, "least"), (1, "greatest")))
    return f"WITH {BOXES_SQL} SELECT id, {cols}, 2 * z0 + id % 3 AS z0, 2 * z1 + id % 3 AS z1 FROM boxes"


_SIDE = lambda p, q, r: f"({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]})"
_A, _B, _C, _D = ("a.x", "a.y"), ("a.bx", "a.by_"), ("b.x", "b.y"), ("b.bx", "b.by_")
_APART = lambda s, t: f"((({s}) > 1e-9 AND ({t}) < -1e-9) OR (({s}) < -1e-9 AND ({t}) > 1e-9))"
_TOL = {k: f"1e-6 * greatest(1, abs(s.{k}0), abs(s.{k}1), abs(v.{k}0), abs(v.{k}1))" for k in "xyz"}
_INVARIANTS = """m AS (SELECT *, (sxx + syy + szz) / 3 AS mean FROM stress), j AS (SELECT *, ((sxx - mean) * (sxx - mean) + (syy - mean) * (syy - mean) + (szz - mean) * (szz - mean)) / 2 + txy * txy + tyz * tyz + txz * txz AS j2,
(sxx - mean) * ((syy - mean) * (szz - mean) - tyz * tyz) - txy * (txy * (szz - mean) - tyz * txz) + txz * (txy * tyz - (syy - mean) * txz) AS j3 FROM m),
l AS (SELECT *, sqrt(j2 / 3) AS r, acos(greatest(-1, least(1, j3 / (2 * pow(j2 / 3, 1.5))))) / 3 AS th FROM j)"""
SQL = {
    "shape_cuts": f"""WITH {BOXES_SQL}, p AS (SELECT *, x0 + (id % 7) / 4 + y0 + 0.5 AS c, z0 + (id % 5) / 4 AS level FROM boxes), l AS (SELECT id, x1 - x0 AS dx, y1 - y0 AS dy, z1 - z0 AS dz, least(x1, c - y0) - greatest(x0, c - y1) AS run, level >= z0 AND level <= z1 AS hit FROM p),
a AS (SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN run > 1e-9 THEN sqrt(2) * run * dz ELSE 0 END ELSE CASE WHEN hit THEN dx * dy ELSE 0 END END AS area FROM l) SELECT id, CASE WHEN area > 0 THEN 4 ELSE 0 END AS points, round(area, 6) AS area FROM a""",
    "shape_outlines": f"""WITH {_RING}, x AS (SELECT a.outline, count(*) AS crossings FROM r a JOIN r b ON a.outline = b.outline AND a.k < b.k WHERE {_APART(_SIDE(_A, _B, _C), _SIDE(_A, _B, _D))} AND {_APART(_SIDE(_C, _D, _A), _SIDE(_C, _D, _B))} GROUP BY 1)
SELECT outline, points, area, repeated, coalesce(crossings, 0) AS crossings FROM (SELECT outline, count(*) AS points, sum(x * by_ - bx * y) / 2 AS area, count(*) - count(DISTINCT [x, y]) AS repeated FROM r GROUP BY 1) LEFT JOIN x USING (outline)""",
    "shape_offsets": f"""WITH {_RING}, n AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS l1, sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)) AS l2 FROM r),
u AS (SELECT *, CASE WHEN l1 > 0 THEN (y - cy) / l1 ELSE 0 END AS ax, CASE WHEN l1 > 0 THEN -(x - cx) / l1 ELSE 0 END AS ay, CASE WHEN l2 > 0 THEN (by_ - y) / l2 ELSE 0 END AS ex, CASE WHEN l2 > 0 THEN -(bx - x) / l2 ELSE 0 END AS ey FROM n),
s AS (SELECT *, CASE WHEN (ax + ex) * ex + (ay + ey) * ey > 1e-12 THEN least(1 / ((ax + ex) * ex + (ay + ey) * ey), 4 / greatest(sqrt((ax + ex) * (ax + ex) + (ay + ey) * (ay + ey)), 1e-12)) ELSE 0 END AS f FROM u)
SELECT outline, seq, round(x + 1.5 * (ax + ex) * f, 5) AS ox, round(y + 1.5 * (ay + ey) * f, 5) AS oy FROM s""",
    "shape_panels": f"""WITH {_OUT}, n AS (SELECT outline AS line, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS l FROM p WINDOW w AS (PARTITION BY outline ORDER BY seq))
SELECT line, count(*) AS panels, round(sum(l), 5) AS length, round(sum(l * 6), 5) AS area FROM n WHERE l IS NOT NULL GROUP BY line""",
    "shape_boxes": f"WITH {_OUT} SELECT outline, min(x) AS x0, max(x) AS x1, min(y) - 0.5 AS y0, max(y) + 0.5 AS y1 FROM p GROUP BY outline",
    "shape_moved": _moved_sql(),
    "shape_adjacent": f"""WITH {BOXES_SQL}, s AS (SELECT id, x1 AS x0, x1, y0, y1, z0, z1, CASE WHEN id % 2 = 0 THEN region END AS region FROM boxes WHERE id % 3 = 0)
SELECT s.id AS surface, v.id AS volume FROM s JOIN boxes v ON {" AND ".join(f"greatest(s.{k}0, v.{k}0) <= least(s.{k}1, v.{k}1) + {_TOL[k]}" for k in "xyz")}
WHERE ({" OR ".join(f"(abs(s.{k}1 - s.{k}0) <= {_TOL[k]} AND (abs(s.{k}0 - v.{k}0) <= {_TOL[k]} OR abs(s.{k}0 - v.{k}1) <= {_TOL[k]}))" for k in "xyz")}) OR ({" AND ".join(f"s.{k}0 >= v.{k}0 - {_TOL[k]} AND s.{k}1 <= v.{k}1 + {_TOL[k]}" for k in "xyz")})
OR coalesce(s.region = v.region, false)""",
    "shape_kinds": f"""WITH {BOXES_SQL}, f AS (SELECT id, unnest(['x0', 'x1', 'y0', 'y1', 'z0', 'z1']) AS label, ['soil', 'wall', 'Horizontal cut', ' ', 'rock'][id % 5 + 1] AS role FROM boxes),
k AS (SELECT CASE WHEN label = 'z1' THEN 'ground_surface' WHEN label = 'z0' THEN 'bottom' WHEN lower(role) LIKE '%horizontal%' THEN 'horizontal_layer' WHEN id % 4 = 0 THEN 'external' ELSE 'unknown' END AS kind,
CASE WHEN trim(role) = '' THEN 'entity' ELSE replace(lower(role), ' ', '_') END AS role, (trim(role) IN ('soil', 'rock') OR id % 7 = 0) AND id % 11 <> 0 AND id % 13 > 0 AS soil, id % 11 = 0 OR role = 'wall' AS cutter, id % 2 = 0 AND id % 3 <> 0 AS pickable FROM f)
SELECT kind, role, soil, cutter, pickable, count(*) AS faces FROM k GROUP BY ALL""",
    "pick_regions": """WITH n AS (SELECT s_suppkey % 30 AS name, 0 AS t, s_suppkey AS seq FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_custkey % 45, 1, c_custkey FROM customer),
r AS (SELECT * FROM n UNION ALL SELECT n_nationkey, 2, n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM n)) SELECT name, arg_min(t, (t, seq)) AS "table", arg_min(seq, (t, seq)) AS seq FROM r GROUP BY name""",
    "pick_meshed": """SELECT count(*) AS objects, CAST(sum(p_partkey) AS BIGINT) AS keys, 'some' AS bound FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 47) OR NOT EXISTS (SELECT 1 FROM part WHERE p_size > 47)
UNION ALL SELECT count(*), CAST(sum(p_partkey) AS BIGINT), 'none' FROM part""",
    "pick_lists": """WITH k AS (SELECT p_partkey AS k, p_size::VARCHAR AS n, ['a', 'b', 'c', 'd'] AS abcd FROM part),
l AS (SELECT k, CASE WHEN k % 6 > 0 THEN (['1.5', 'x', n])[1:k % 4] ELSE [] END AS v, CASE WHEN k % 3 > 0 THEN abcd[k % 2 + 1:k % 2 + k % 3] END AS a, CASE WHEN k % 4 > 0 THEN abcd[k % 3 + 1:k % 3 + k % 4] END AS b FROM k)
SELECT k AS p_partkey, array_to_string([coalesce(TRY_CAST(v[i] AS DOUBLE), -1.0::DOUBLE) FOR i IN [1, 2, 3]], ',') AS values, coalesce(array_to_string(list_sort(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE list_filter(a, lambda x: list_contains(b, x)) END), ','), '*') AS shared,
array_to_string(list_sort(list_filter(coalesce(a, ['d', 'c', 'a', 'b']), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS snapshot, k % 3 <> 0 AS kept, CASE WHEN k % 9 > 0 THEN 's1' END AS stage
FROM l WHERE CASE WHEN k % 9 > 0 THEN 's1' END IS NOT DISTINCT FROM CASE WHEN k % 2 = 0 THEN 's1' END""",
    "stage_states": """WITH RECURSIVE e AS (SELECT event_id % 8 + 1 AS stage, user_id % 40 AS region, event_id // 8 % 5 AS rank, event_id FROM events),
s AS (SELECT stage, region, rank, bool_and(CASE rank WHEN 0 THEN event_id % 3 = 0 ELSE rank IN (1, 3) END) AS active FROM e WHERE stage <> 3 GROUP BY ALL),
l AS (SELECT stage, region, arg_max(active, rank) AS said FROM s GROUP BY ALL UNION ALL SELECT DISTINCT 3, user_id % 40, false FROM events), a AS (SELECT list(DISTINCT user_id % 40) AS every FROM events),
o AS (SELECT t.stage, coalesce(list(region) FILTER (WHERE said), []) AS ons, coalesce(list(region) FILTER (WHERE NOT said), []) AS offs FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS stage) t LEFT JOIN l ON l.stage = t.stage GROUP BY t.stage),
w AS (SELECT 0 AS stage, every, every AS active FROM a UNION ALL SELECT stage, every, CASE WHEN len(n) = 0 THEN every ELSE n END
FROM (SELECT o.stage, every, list_filter(every, lambda r: list_contains(ons, r) OR (list_contains(active, r) AND NOT list_contains(offs, r))) AS n FROM w JOIN o ON o.stage = w.stage + 1))
SELECT stage::BIGINT AS stage, region, list_contains(active, region) AS is_active FROM (SELECT stage, active, unnest(every) AS region FROM w WHERE stage > 0)""",
    "state_eigenvalues": f"""WITH {STRESS_SQL}, {_INVARIANTS} SELECT l_partkey % 50 AS material, round(avg(mean + 2 * r * cos(th)), 4) AS a, round(avg(mean + 2 * r * cos(th - 2 * pi() / 3)), 4) AS b, round(avg(mean + 2 * r * cos(th + 2 * pi() / 3)), 4) AS c,
round(avg(2 * sin(radians(phi)) / (sqrt(3) * (3 - sin(radians(phi))))), 4) AS alpha, round(avg(6 * cohesion * cos(radians(phi)) / (sqrt(3) * (3 - sin(radians(phi))))), 4) AS k FROM l GROUP BY 1""",
}
