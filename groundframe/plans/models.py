"""Model queries: phases, transfers, forces and merges over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mesh
from ..operators import transfer as t
from ..session import table
from .views import CELLS_SQL, FACES_SQL, NX, NY, cells


def _activity(spark, sf):
    """Every event type is active from the phase that its name's length gives."""
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("region")).distinct()
    return kinds.withColumn("phase", F.explode(F.sequence(F.lit(4), F.lit(8)))).withColumn("is_active", F.length("region") <= F.col("phase"))


def _materials(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("region")).distinct().where("region <> 'error'").withColumn("material", F.upper("region"))


def phases(spark, sf):
    """JOIN-12, FLT-11, AGG-32."""
    return t.phase_summary(t.phase_elements(cells(spark, sf), _activity(spark, sf), _materials(spark, sf)))


def compact(spark, sf):
    """JOIN-12: node numbers in one phase, as sums.

    A number in a phase is at most the range of node ids. Where that allows sums beyond 64 bits, at which the SQL's cast
    stops, the products are exact decimals; elsewhere they have the SQL's type.
    """
    c = cells(spark, sf)
    e = t.phase_elements(c, _activity(spark, sf), _materials(spark, sf))
    low, high = c.agg(F.min(F.array_min("conn")), F.max(F.array_max("conn"))).first()
    wide = low is not None and (high - low + 1) ** 2 * max(abs(low), abs(high)) >= 1 << 63
    number = lambda k: F.col(k).cast("decimal(19,0)" if wide else "long")
    return t.compact_nodes(e).groupBy("phase").agg(F.count("*").alias("n"), F.min("new_id").alias("low"), F.max("new_id").alias("high"), F.sum(number("new_id") * number("node_id")).alias("product"))


def forces(spark, sf):
    """AGG-27, NUM-13: unit pressure on every boundary face."""
    b = mesh.face_uses(cells(spark, sf)).where("kind = 'boundary'").select(F.col("face_key").alias("conn"), F.lit(1.0).alias("area"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(-4.0).alias("tz"))
    return t.nodal_forces(b)


def sets(spark, sf):
    """SPA-08."""
    c = cells(spark, sf)
    return t.node_sets(mesh.lattice_nodes(c, NX, NY)).groupBy("set").agg(F.count("*").alias("nodes"))


def gaps(spark, sf):
    """WIN-09."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 40 * 2.5).alias("x"), (F.col("p_size") * 3.0).alias("y"), F.lit(1.0).alias("z"))
    return t.spacing(p)


def _entities(spark, sf, name, p):
    k, n = F.col(f"{p}key"), F.col(f"{name[0]}_nationkey")
    return table(spark, sf, name).select(
        k.alias("id"), (k % 10).cast("double").alias("x"), (k % 7).cast("double").alias("y"), F.lit(0.0).alias("z"), (k % 211).alias("fingerprint"), (k % 97).alias("key"), (k % 89).alias("feature"), n.alias("kind"), (n % 3).alias("role")
    )


def matches(spark, sf):
    """JOIN-10, JOIN-11, FLT-19."""
    out = t.best_matches(_entities(spark, sf, "supplier", "s_supp"), _entities(spark, sf, "customer", "c_cust"), reach=5.0)
    return out.withColumn("score", F.round("score", 6))


def decisions(spark, sf):
    """FLT-19, FLT-20, JOIN-10: matches under review, and what the reviewers said."""
    queue = t.review_queue(t.best_matches(_entities(spark, sf, "supplier", "s_supp"), _entities(spark, sf, "customer", "c_cust"), reach=5.0))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    said = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.floor(k / 2).alias("old_id"), F.get(F.array(*map(F.lit, ("accept", "map", "reject", "later"))), (n % 4).cast("int")).alias("action"), (k + 1000).alias("target"), k.alias("seq"))
    return t.apply_decisions(queue, said)


def carried(spark, sf):
    """JOIN-11: bindings by brand, by full name, and to nothing."""
    k = F.col("p_partkey")
    names = table(spark, sf, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("name"))
    target = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.concat_ws(":", "p_brand", "p_type")).otherwise(F.concat(F.col("p_brand"), F.lit("x")))
    out = t.transfer_bindings(table(spark, sf, "part").select(k.alias("binding"), target.alias("target")), names)
    return out.groupBy("how").agg(F.count("*").alias("rows"), F.count_distinct("binding").alias("bindings"), F.min("name").alias("first"))


def region_materials(spark, sf):
    """FLT-02."""
    regions = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.concat(F.lit("soil_"), F.col("p_size").cast("string"))).alias("region"))
    mats = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("soil_"), F.col("p_size").cast("string")).alias("name")).distinct()
    return t.materials_for(regions, mats)


def merged(spark, sf):
    """AGG-24, MUT-10, SET-01: a mesh joined to itself with an offset, two regions made one."""
    c = cells(spark, sf)
    n = mesh.lattice_nodes(c, NX, NY)
    both, _ = t.combine((c, n), (c, n))
    return t.merge_regions(both, ["click", "view"], "seen").groupBy("region").agg(F.count("*").alias("cells"), F.count_distinct("cell_id").alias("ids"), F.max("cell_id").alias("last"))


def crossing(spark, sf):
    """JOIN-06: triangles in three directions around points of a grid, a layer of it for every 1600 parts, four at each of its points."""
    k = F.col("p_partkey")
    at = lambda i, j: F.struct((k % 20 + i).cast("double").alias("x"), (F.floor(k / 20) % 20 + j).cast("double").alias("y"), F.floor(k / 1600).cast("double").alias("z"))
    tri = table(spark, sf, "part").select(k.alias("cell_id"), F.array(k, k + 1, k + 20).alias("conn"), F.array(at(0.0, 0.0), at(0.5, 0.0), at(0.0, 1.0)).alias("pts"))
    return t.intersection_candidates(tri)


_ACT = "act AS (SELECT DISTINCT event_type AS region, unnest([4, 5, 6, 7, 8]) AS phase FROM events), el AS (SELECT phase, cells.* FROM act JOIN cells USING (region) WHERE length(region) <= phase)"
QUERIES = {
    "model_phases": phases, "model_compact": compact, "model_forces": forces, "model_node_sets": sets, "model_spacing": gaps, "model_matches": matches, "model_materials": region_materials, "model_merged": merged, "model_crossing": crossing, "model_crossing_all": crossing, "model_decisions": decisions, "model_carried": carried,
}
_ENT = "(k % 10) AS x, (k % 7) AS y, k % 211 AS fingerprint, k % 97 AS key, k % 89 AS feature, n AS kind, n % 3 AS role"
SQL = {
    "model_phases": f"""WITH {CELLS_SQL}, {_ACT}, n AS (SELECT phase, count(DISTINCT node) AS nodes FROM (SELECT phase, unnest(conn) AS node FROM el) GROUP BY phase)
SELECT phase, cells, unmapped, nodes FROM (SELECT phase, count(*) AS cells, count(*) FILTER (WHERE region = 'error') AS unmapped FROM el GROUP BY phase) JOIN n USING (phase)""",
    "model_compact": f"""WITH {CELLS_SQL}, {_ACT}, u AS (SELECT DISTINCT phase, unnest(conn) AS node_id FROM el), r AS (SELECT phase, node_id, row_number() OVER (PARTITION BY phase ORDER BY node_id) - 1 AS new_id FROM u)
SELECT phase, count(*) AS n, min(new_id) AS low, max(new_id) AS high, CAST(sum(new_id * node_id) AS BIGINT) AS product FROM r GROUP BY phase""",
    "model_forces": f"WITH {FACES_SQL} SELECT node AS node_id, 0.0::DOUBLE AS fx, 0.0::DOUBLE AS fy, -count(*)::DOUBLE AS fz FROM (SELECT unnest(face_key) AS node FROM kinds WHERE kind = 'boundary') GROUP BY node",
    "model_node_sets": f"""WITH {CELLS_SQL}, u AS (SELECT DISTINCT unnest(conn) AS n FROM cells), p AS (SELECT n % 21 AS x, n // 21 % 21 AS y, n // 441 AS z FROM u),
m AS (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM p)
{' UNION ALL '.join(f"SELECT '{k}{s}' AS set, count(*) AS nodes FROM p, m WHERE {k} = {k}{s}" for k in "xyz" for s in ("min", "max"))}""",
    "model_spacing": """WITH p AS (SELECT p_partkey % 40 * 2.5::DOUBLE AS x, p_size * 3.0::DOUBLE AS y FROM part),
gx AS (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT x FROM p)), gy AS (SELECT y - lag(y) OVER (ORDER BY y) AS g FROM (SELECT DISTINCT y FROM p))
SELECT (SELECT min(g) FROM gx) AS dx, (SELECT min(g) FROM gy) AS dy, NULL::DOUBLE AS dz""",
    "model_matches": f"""WITH o AS (SELECT k AS old_id, {_ENT} FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)), w AS (SELECT k AS new_id, {_ENT} FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer)),
s AS (SELECT old_id, new_id, 10.0::DOUBLE * (o.fingerprint = w.fingerprint)::INT + 5 * (o.key = w.key)::INT + 3 * (o.feature = w.feature)::INT + 2 * (o.kind = w.kind)::INT + (o.role = w.role)::INT
+ greatest(0, 2 * (1 - sqrt((o.x - w.x) * (o.x - w.x) + (o.y - w.y) * (o.y - w.y)) / 5)) AS score FROM o JOIN w ON o.fingerprint = w.fingerprint OR o.key = w.key OR o.feature = w.feature),
b AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) AS turn FROM s)
SELECT old_id, new_id, round(score, 6) AS score, CASE WHEN score < 6 THEN 'weak' WHEN score < 8 THEN 'review' ELSE 'auto' END AS status FROM b WHERE turn = 1""",
    "model_decisions": f"""WITH o AS (SELECT k AS old_id, {_ENT} FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)), w AS (SELECT k AS new_id, {_ENT} FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer)),
s AS (SELECT old_id, new_id, 10.0::DOUBLE * (o.fingerprint = w.fingerprint)::INT + 5 * (o.key = w.key)::INT + 3 * (o.feature = w.feature)::INT + 2 * (o.kind = w.kind)::INT + (o.role = w.role)::INT
+ greatest(0, 2 * (1 - sqrt((o.x - w.x) * (o.x - w.x) + (o.y - w.y) * (o.y - w.y)) / 5)) AS score FROM o JOIN w ON o.fingerprint = w.fingerprint OR o.key = w.key OR o.feature = w.feature),
b AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY score DESC, new_id) AS turn FROM s),
d AS (SELECT c_custkey // 2 AS old_id, arg_max(['accept', 'map', 'reject', 'later'][c_nationkey % 4 + 1], c_custkey) AS action, max(c_custkey) + 1000 AS target FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1),
r AS (SELECT old_id, new_id, target, CASE WHEN action = 'accept' THEN 'accepted' WHEN action = 'map' THEN 'mapped' WHEN action IS NOT NULL THEN 'rejected' WHEN score >= 8 THEN 'accepted' ELSE 'waiting' END AS state FROM b LEFT JOIN d USING (old_id) WHERE turn = 1)
SELECT old_id, CASE state WHEN 'accepted' THEN new_id WHEN 'mapped' THEN target END AS new_id, state FROM r""",
    "model_carried": """WITH n AS (SELECT DISTINCT p_brand AS brand, p_brand || ':' || p_type AS name FROM part), b AS (SELECT p_partkey AS k, p_brand AS brand, p_brand || ':' || p_type AS name FROM part),
r AS (SELECT 'contains' AS how, k, n.name FROM b JOIN n USING (brand) WHERE k % 3 = 0 UNION ALL SELECT 'exact', k, name FROM b WHERE k % 3 = 1 UNION ALL SELECT 'unmatched', k, NULL FROM b WHERE k % 3 = 2)
SELECT how, count(*) AS rows, count(DISTINCT k) AS bindings, min(name) AS first FROM r GROUP BY how""",
    "model_materials": """WITH r AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE 'soil_' || p_size END AS region FROM part), m AS (SELECT DISTINCT 'soil_' || p_size AS name FROM part WHERE p_partkey % 5 = 0)
SELECT region, coalesce(name, CASE WHEN region LIKE 'soil%' THEN (SELECT min(name) FROM m) END) AS material FROM r LEFT JOIN m ON name = region""",
    "model_merged": f"""WITH {CELLS_SQL}, b AS (SELECT cell_id, region FROM cells UNION ALL SELECT cell_id + (SELECT max(cell_id) + 1 FROM cells), region FROM cells)
SELECT CASE WHEN region IN ('click', 'view') THEN 'seen' ELSE region END AS region, count(*) AS cells, count(DISTINCT cell_id) AS ids, max(cell_id) AS last FROM b GROUP BY 1""",
    "model_crossing_all": """WITH t AS (SELECT p_partkey AS id, p_partkey % 20 AS x, p_partkey // 20 % 20 AS y, p_partkey // 1600 AS z FROM part)
SELECT a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.z = b.z AND a.id < b.id AND least(a.x, b.x) + 0.5 >= greatest(a.x, b.x) AND least(a.y, b.y) + 1 >= greatest(a.y, b.y)
WHERE NOT list_has_any([a.id, a.id + 1, a.id + 20], [b.id, b.id + 1, b.id + 20])""",
}
SQL["model_crossing"] = SQL["model_crossing_all"]
