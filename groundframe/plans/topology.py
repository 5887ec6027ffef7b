"""Topology queries over boxes out of `part` and links out of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topology as o
from ..session import table, tasks_for
from .blocks import _CONTACTS
from .views import BOXES_SQL, boxes


def counts(spark, sf):
    """GEN-19, GEN-32, JOIN-19."""
    return o.topology_counts(boxes(spark, sf))


def shared_cells(spark, sf):
    """SET-08, GEN-24."""
    c = o.shared_node_cells(boxes(spark, sf))
    return o.region_nodes(c, tasks_for(table(spark, sf, "part")))


def contacts(spark, sf):
    """JOIN-04."""
    return o.face_contacts(boxes(spark, sf))


def assembly(spark, sf):
    """JOIN-15."""
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 25).alias("interface"), F.col("l_partkey").alias("slave"), F.col("l_suppkey").alias("master"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity") - 3).alias("area"))
    n = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("node_id"))
    return o.contact_assembly(p, n)


def bound(spark, sf):
    """JOIN-18."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    e = table(spark, sf, "lineitem").select(k.alias("entity"), F.get(F.array(*map(F.lit, ("solid", "face", "edge"))), (F.col("l_linenumber") % 3).cast("int")).alias("kind"), F.col("l_suppkey").alias("owner"))
    m = table(spark, sf, "supplier").where("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("owner"), F.concat(F.lit("mat_"), F.col("s_nationkey").cast("string")).alias("material"))
    p = table(spark, sf, "lineitem").where("l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 5).alias("phase"))
    return o.bind_entities(e, m, p).groupBy("kind", "status").agg(F.count("*").alias("entities"), F.count_distinct("material").alias("materials"), F.sum("phases").alias("phases"))


def _versions(spark, sf):
    """Boxes before and after an operation: every third keeps its name, the others are moved and renamed, and some are cut in two."""
    b = boxes(spark, sf).withColumns({"op": F.floor(F.col("id") / 20), "kind": F.lit("solid"), "name": F.concat(F.lit("b"), F.col("id").cast("string")), "plane": (F.col("id") % 4).cast("string")})
    new = b.withColumn("part", F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    named = F.when((F.col("id") % 3 == 0) & (F.col("part") == 0), F.col("name")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
    far = F.when(F.col("id") % 17 == 0, 1000.0).otherwise(0.0)
    new = new.withColumns({"name": named, "x0": F.col("x0") + 0.25 + far, "x1": F.col("x1") + 0.25 + far, "z0": F.when(F.col("part") == 1, F.col("z0") + 0.5).otherwise(F.col("z0")), "id": F.col("id") * 2 + F.col("part")})
    return b, new


def lineage(spark, sf):
    """JOIN-24, VAL-14."""
    return o.lineage(*_versions(spark, sf))


def closest(spark, sf):
    """JOIN-29, MUT-16."""
    mid = {k: (F.col(f"{k}0") + F.col(f"{k}1")) / 2 for k in "xyz"}
    b = boxes(spark, sf).select("id", (F.col("id") % 6).alias("role"), *(v.alias(k) for k, v in mid.items()))
    new = b.where("id % 4 = 1").select((F.col("id") + 100_000).alias("id"), (F.col("id") % 5).alias("role"), (F.col("x") + 0.3).alias("x"), "y", "z")
    return o.closest_blocks(b, new, 2.0).withColumn("distance", F.round("distance", 6))


def policies(spark, sf):
    """JOIN-20, JOIN-21."""
    orders = table(spark, sf, "orders")
    t = lambda c, m, r: orders.where(f"o_orderkey % {m} = {r}").select((F.col("o_custkey") % c).alias("name"), F.col("o_orderpriority").alias("policy"))
    return o.mesh_policies(t(100, 3, 0), t(60, 5, 1), t(30, 7, 2), t(150, 2, 0))


def hops(spark, sf):
    """GRA-04, GRA-05, JOIN-22."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") * 3).alias("target"), F.col("l_returnflag").alias("relation"))
    n = table(spark, sf, "part").where("p_size < 12").select(F.col("p_partkey").alias("node"))
    out = o.hops(e, n, ["A", "R"]).withColumn("way", F.lit("out")).union(o.hops(e, n, ["A", "R"], outgoing=False).withColumn("way", F.lit("in")))
    return out.groupBy("way", "relation").agg(F.count("*").alias("links"), F.count_distinct("node").alias("nodes"), F.sum("other").alias("others"))


def sizes(spark, sf):
    """SPA-06."""
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("surface"), (F.col("p_size") % 8).alias("role"))
    f = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("role"), (1 - F.col("r_regionkey") / 10).alias("factor"))
    c = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("surface"), (F.col("s_nationkey") / 4).alias("size"))
    return o.size_field(s, f, c, 2.0)


def names(spark, sf):
    """SET-12."""
    a = table(spark, sf, "customer").select(F.concat(F.lit("v"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").alias("seq"))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("v"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.col("s_suppkey").alias("seq"))
    return o.unique_names(a, b)


QUERIES = {
    "topo_counts": counts, "topo_shared": shared_cells, "topo_contacts": contacts, "topo_assembly": assembly, "topo_bound": bound, "topo_lineage": lineage, "topo_closest": closest, "topo_policies": policies,
    "topo_hops": hops, "topo_sizes": sizes, "topo_names": names,
}
_AT = [f"[{', '.join(f'{k}{s}' for k, s in zip('xyz', c, strict=True))}]" for c in o.CORNERS]


def _entities(kind: str, of: str) -> str:
    return f"SELECT '{kind}' AS kind, count(*) AS entities, count(*) FILTER (WHERE a <> b) AS shared FROM (SELECT e, min(id) AS a, max(id) AS b FROM (SELECT id, unnest({of}) AS e FROM boxes) GROUP BY e)"


_LISTS = {
    "face": "[" + ", ".join("list_sort([" + ", ".join(_AT[i] for i in f) + "])" for f in o.BOX_FACES.values()) + "]",
    "edge": "[" + ", ".join(f"list_sort([{_AT[a]}, {_AT[b]}])" for a, b in o.BOX_EDGES) + "]",
    "vertex": "[" + ", ".join(_AT) + "]",
}
_OVER = " * ".join(f"greatest(0, least(n.{k}1, o.{k}1) - greatest(n.{k}0, o.{k}0))" for k in "xyz")
SQL = {
    "topo_counts": f"WITH {BOXES_SQL} SELECT 'solid' AS kind, count(*) AS entities, 0::BIGINT AS shared FROM boxes UNION ALL " + " UNION ALL ".join(_entities(k, v) for k, v in _LISTS.items()),
    "topo_shared": f"WITH {BOXES_SQL}, c AS (SELECT region, unnest({_LISTS['vertex']}) AS n FROM boxes) SELECT region, count(*) AS corners, count(DISTINCT n) AS nodes FROM c GROUP BY region",
    "topo_contacts": f"WITH {BOXES_SQL}, c AS ({_CONTACTS}) SELECT id_a, id_b, axis || '1' AS label_a, axis || '0' AS label_b, area FROM c",
    "topo_assembly": """WITH p AS (SELECT l_orderkey % 25 AS interface, l_partkey AS s, l_suppkey AS m, CASE WHEN l_linenumber < 6 THEN l_quantity - 3 END AS area FROM lineitem), n AS (SELECT p_partkey AS k FROM part WHERE p_size > 10),
j AS (SELECT *, s IN (SELECT k FROM n) AND m IN (SELECT k FROM n) AS ok FROM p) SELECT interface, count(*) AS pairs, count(*) FILTER (WHERE ok AND area > 0) AS effective, count(*) FILTER (WHERE ok AND NOT coalesce(area > 0, false)) AS zero, count(*) FILTER (WHERE NOT ok) AS missing FROM j GROUP BY 1""",
    "topo_bound": """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS entity, ['solid', 'face', 'edge'][l_linenumber % 3 + 1] AS kind, l_suppkey AS owner FROM lineitem), p AS (SELECT l_suppkey AS owner, count(DISTINCT l_partkey % 5) AS phases FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1),
j AS (SELECT kind, CASE WHEN kind <> 'edge' AND owner % 4 > 0 THEN s_nationkey END AS material, coalesce(phases, 0) AS phases FROM e LEFT JOIN supplier ON owner = s_suppkey LEFT JOIN p USING (owner))
SELECT kind, CASE WHEN kind = 'solid' AND material IS NULL THEN 'unbound' WHEN phases = 0 THEN 'no_phase' ELSE 'bound' END AS status, count(*) AS entities, count(DISTINCT material) AS materials, CAST(sum(phases) AS BIGINT) AS phases FROM j GROUP BY ALL""",
    "topo_lineage": f"""WITH {BOXES_SQL}, o AS (SELECT *, id // 20 AS op, 'b' || id AS name, id % 4 AS plane FROM boxes),
n AS (SELECT id * 2 + part AS id, op, plane, CASE WHEN id % 3 = 0 AND part = 0 THEN name ELSE 'n' || id END AS name, x0 + 0.25 + CASE WHEN id % 17 = 0 THEN 1000 ELSE 0 END AS x0, x1 + 0.25 + CASE WHEN id % 17 = 0 THEN 1000 ELSE 0 END AS x1, y0, y1,
CASE part WHEN 1 THEN z0 + 0.5 ELSE z0 END AS z0, z1 FROM (SELECT *, unnest(CASE WHEN id % 5 = 0 THEN [0, 1] ELSE [0] END) AS part FROM o)),
m AS (SELECT n.id, min(o.id) AS old_id FROM n JOIN o ON n.op = o.op AND n.name = o.name GROUP BY n.id),
c AS (SELECT n.id, o.id AS old_id, {_OVER} AS v, {_OVER} / 10 + CASE WHEN n.plane = o.plane THEN 10 ELSE 0 END AS score FROM n JOIN o ON n.op = o.op WHERE n.id NOT IN (SELECT id FROM m)),
b AS (SELECT id, arg_min(old_id, (-score, old_id)) AS old_id FROM c WHERE v > 0 GROUP BY id), r AS (SELECT n.id AS new_id, coalesce(m.old_id, b.old_id) AS old_id FROM n LEFT JOIN m ON m.id = n.id LEFT JOIN b ON b.id = n.id)
SELECT new_id, old_id, CASE WHEN old_id IS NULL THEN 'generated' WHEN count(*) OVER (PARTITION BY old_id) > 1 THEN 'split' ELSE 'preserved' END AS type FROM r""",
    "topo_closest": f"""WITH {BOXES_SQL}, b AS (SELECT id, id % 6 AS role, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, (z0 + z1) / 2 AS z FROM boxes), n AS (SELECT id + 100000 AS id, id % 5 AS role, x + 0.3::DOUBLE AS x, y, z FROM b WHERE id % 4 = 1),
c AS (SELECT b.id AS old_id, n.id AS new_id, b.role <> n.role AS other_role, sqrt((b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y) + (b.z - n.z) * (b.z - n.z)) AS distance FROM b JOIN n ON abs(b.x - n.x) <= 2 AND abs(b.y - n.y) <= 2 AND abs(b.z - n.z) <= 2)
SELECT old_id, new_id, round(distance, 6) AS distance, other_role FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY other_role, distance, new_id) AS turn FROM c WHERE distance <= 2) WHERE turn = 1""",
    "topo_policies": """WITH r AS (SELECT o_custkey % 30 AS name, o_orderpriority AS policy, 'row' AS source, 0 AS rank FROM orders WHERE o_orderkey % 7 = 2 UNION ALL SELECT o_custkey % 60, o_orderpriority, 'pair', 1 FROM orders WHERE o_orderkey % 5 = 1
UNION ALL SELECT o_custkey % 100, o_orderpriority, 'edge', 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey % 150, o_orderpriority, 'protected', 3 FROM orders WHERE o_orderkey % 2 = 0)
SELECT name, policy, source FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, policy) AS turn FROM r) WHERE turn = 1""",
    "topo_hops": """WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey * 3 AS t, l_returnflag AS relation FROM lineitem WHERE l_returnflag IN ('A', 'R')), n AS (SELECT p_partkey AS k FROM part WHERE p_size < 12),
h AS (SELECT 'out' AS way, relation, s AS node, t AS other FROM e WHERE s IN (SELECT k FROM n) UNION ALL SELECT 'in', relation, t, s FROM e WHERE t IN (SELECT k FROM n))
SELECT way, relation, count(*) AS links, count(DISTINCT node) AS nodes, CAST(sum(other) AS BIGINT) AS others FROM h GROUP BY ALL""",
    "topo_sizes": """WITH f AS (SELECT r_regionkey AS role, 1 - r_regionkey / 10 AS factor FROM region), c AS (SELECT s_suppkey * 7 AS surface, min(s_nationkey / 4) AS own FROM supplier GROUP BY 1),
j AS (SELECT p_partkey AS surface, coalesce(factor, 1) AS factor, own FROM part LEFT JOIN f ON p_size % 8 = role LEFT JOIN c ON p_partkey = c.surface)
SELECT surface, coalesce(own, factor * 2) AS size, CASE WHEN own IS NULL THEN 'role' ELSE 'user' END AS source FROM j WHERE factor < 0.999 OR own IS NOT NULL""",
    "topo_names": """WITH r AS (SELECT 0 AS origin, c_custkey AS seq, 'v' || (c_custkey % 40) AS given FROM customer UNION ALL SELECT 1, s_suppkey, 'v' || (s_suppkey % 60) FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY given ORDER BY origin, seq) AS k FROM r) SELECT origin, seq, given, CASE WHEN k > 1 AND origin = 1 THEN given || '_' || k ELSE given END AS name FROM n""",
}
