"""Report and readiness queries over orders, lines and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as b
from ..operators import reports as o
from ..session import table
from .blocks import _CONTACTS
from .views import BOXES_SQL, boxes

_TYPES = ["hex8", "Tet4", "TRI3", "quad4", "line"]


def _cells(spark, sf):
    k = F.col("l_orderkey")
    kind = F.when(k % 6 < 4, F.lit("hex8")).otherwise(F.get(F.array(*map(F.lit, _TYPES)), (F.col("l_partkey") % 5).cast("int")))
    return table(spark, sf, "lineitem").select(kind.alias("cell_type"), (F.col("l_suppkey") % 40).alias("region"), F.when(F.col("l_linenumber") > 5, "").otherwise(F.concat(F.lit("mat_"), (F.col("l_partkey") % 30).cast("string"))).alias("material"))


_CELLS = """cells AS (SELECT CASE WHEN l_orderkey % 6 < 4 THEN 'hex8' ELSE ['hex8', 'Tet4', 'TRI3', 'quad4', 'line'][l_partkey % 5 + 1] END AS cell_type, l_suppkey % 40 AS region,
CASE WHEN l_linenumber > 5 THEN '' ELSE 'mat_' || (l_partkey % 30) END AS material FROM lineitem)"""


def mesh(spark, sf):
    """AGG-28."""
    return o.mesh_summary(_cells(spark, sf))


def solid(spark, sf):
    """VAL-07."""
    k = F.col("o_orderkey")
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("model"), F.when(F.col("l_orderkey") % 3 == 0, F.get(F.array(*map(F.lit, _TYPES[2:])), (F.col("l_partkey") % 2).cast("int"))).otherwise("hex8").alias("cell_type"), F.when(F.col("l_orderkey") % 5 > 0, 3).alias("d"))
    none = table(spark, sf, "orders").where(k % 7 == 0).select((-k).alias("model"), F.lit(None).cast("string").alias("cell_type"), F.lit(3).alias("d"))
    out = o.mesh_readiness(line.union(none), F.max("d"))
    return out.groupBy("code", "severity").agg(F.count("*").alias("models"), F.min("model").alias("first"))


_DOFS = ["ux,uy,uz", "uz", "", " ux; uy,", ";;"]
_KINDS = ["Body_Force", "gravity", "nodal", "point_load", "pressure", None]


def _orders(spark, sf):
    c = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, _DOFS)), (c % 5).cast("int")).alias("dof"), F.get(F.array(*map(F.lit, _KINDS)), (c % 6).cast("int")).alias("kind"), c.alias("target"), F.col("o_orderstatus").alias("stage"),
        F.when(c % 7 == 0, None).when(c % 7 == 1, "").otherwise(F.concat(F.lit("mat_"), (c % 30).cast("string"))).alias("material"), F.when(c % 4 > 0, F.get(F.array(F.lit("tied"), F.lit("frictional"), F.lit("open")), (c % 3).cast("int"))).alias("mode"),
    )


_ORDERS = """o AS (SELECT o_orderkey AS id, ['ux,uy,uz', 'uz', '', ' ux; uy,', ';;'][o_custkey % 5 + 1] AS dof, ['Body_Force', 'gravity', 'nodal', 'point_load', 'pressure', NULL][o_custkey % 6 + 1] AS kind, o_custkey AS target, o_orderstatus AS stage,
CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'mat_' || (o_custkey % 30) END AS material, CASE WHEN o_custkey % 4 > 0 THEN ['tied', 'frictional', 'open'][o_custkey % 3 + 1] END AS mode FROM orders)"""
_MATS = "m AS (SELECT 'mat_' || n_nationkey AS material, (n_nationkey - 3)::DOUBLE AS kn, (n_nationkey % 6)::DOUBLE AS ks FROM nation)"


def _materials(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.concat(F.lit("mat_"), n.cast("string")).alias("material"), (n - 3).cast("double").alias("kn"), (n % 6).cast("double").alias("ks"))


def conditions(spark, sf):
    """AGG-29."""
    return o.condition_summary(_orders(spark, sf))


def loads(spark, sf):
    """AGG-30."""
    return o.load_summary(_orders(spark, sf))


def interfaces(spark, sf):
    """AGG-31."""
    return o.interface_summary(_orders(spark, sf).withColumn("material", F.when(F.col("material") != "", F.col("material"))), _materials(spark, sf))


def contact(spark, sf):
    """VAL-09."""
    return o.contact_readiness(_orders(spark, sf).withColumnRenamed("id", "interface"), _materials(spark, sf)).groupBy("code").agg(F.count("*").alias("interfaces"), F.max("interface").alias("last"))


def mapping(spark, sf):
    """JOIN-16, JOIN-17, JOIN-30."""
    return o.material_mapping(_cells(spark, sf), _materials(spark, sf).where("ks > 0").unionByName(spark.createDataFrame([("mat_99", 1.0, 1.0)], "material string, kn double, ks double")))


def _candidates(spark, sf):
    c = b.block_contacts(boxes(spark, sf))
    return c.select("region_a", "region_b", "axis", F.concat_ws("|", F.least("region_a", "region_b"), F.greatest("region_a", "region_b")).alias("pair"), F.when(F.col("region_a") == F.col("region_b"), "tie").otherwise("contact").alias("mode"), "area")


def conformity(spark, sf):
    """VAL-06."""
    c = _candidates(spark, sf)
    return o.interface_conformity(c.withColumn("mode", F.concat("axis", F.lit("_"), "mode")), c.where("mode = 'tie' or axis = 'x'").select("pair"))


def made(spark, sf):
    """JOIN-27."""
    c = _candidates(spark, sf).select(F.when(F.col("axis") == "z", "").otherwise(F.col("region_a")).alias("a"), F.col("region_b").alias("b"))
    old = boxes(spark, sf).select(F.concat(F.lit("interface_"), "region", F.lit("_Brand#11")).alias("interface")).distinct()
    return o.materialise(c, old)


def requests(spark, sf):
    """MUT-19."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, sf, "orders").select(k.alias("seq"), F.when(c % 9 > 0, c % 12).alias("a"), (c % 17).alias("b"), F.get(F.array(*map(F.lit, ("contact", "tie", "release", "weld"))), (k % 4).cast("int")).alias("mode"), (k % 3 == 0).alias("exact"))
    n = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 12).alias("a"), (F.col("l_suppkey") % 9 + 12).alias("b")).agg((F.max("l_quantity") % 3).cast("long").alias("shared"))
    return o.request_status(r, n)


def assets(spark, sf):
    """AGG-13."""
    c = _candidates(spark, sf)
    a = c.groupBy("pair", F.when(F.col("mode") == "tie", "continuity_tie").otherwise("node_pair_contact").alias("request"), F.when(F.col("axis") == "z", "merge").otherwise("duplicate").alias("policy")).agg(F.sum("area").alias("area"))
    return o.asset_summary(a.withColumn("ready", F.col("area") >= 2))


def results(spark, sf):
    """AGG-22, AGG-34, AGG-35."""
    e = table(spark, sf, "events")
    f = e.select((F.col("user_id") % 20).alias("stage"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 6 > 0, F.col("value")).alias("value"))
    m = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("stage"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(1.0)).alias("a"), F.when(F.col("n_nationkey") % 3 < 2, F.lit(2.0)).alias("b"))
    return o.result_records(f, m)


def records(spark, sf):
    """AGG-19, AGG-20, AGG-36, FLT-08, FLT-09."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return o.block_records(p.select(F.col("p_brand").alias("region"), (k % 9 > 0).alias("visible"), (k % 2 == 0).alias("locked"), F.when(k % 3 == 0, F.col("p_type")).alias("material"), (F.col("p_size") % 6).alias("stage")))


def accepted(spark, sf):
    """VAL-11."""
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(k.alias("package"), F.when(k % 11 > 0, k % 5 > 0).alias("valid"))
    m = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(k.alias("package"), (k % 8 > 0).alias("accepted"))
    return o.acceptance(p, m).groupBy("accepted", "reason").agg(F.count("*").alias("packages"))


def _bindings(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("entity"), F.get(F.array(*map(F.lit, ("solid", "face", "edge"))), (k % 3).cast("int")).alias("kind"), F.when(k % 5 > 0, F.col("p_brand")).alias("material"), F.when(k % 7 > 0, F.col("p_size")).alias("phase"), F.when(k % 4 > 0, F.col("p_type")).alias("role")
    )


_BIND = "p AS (SELECT p_partkey AS k, ['solid', 'face', 'edge'][p_partkey % 3 + 1] AS kind FROM part)"


def bound(spark, sf):
    """VAL-13, VAL-15."""
    return o.binding_checks(_bindings(spark, sf))


def _case(spark, sf):
    orders, cust = table(spark, sf, "orders"), table(spark, sf, "customer")
    cases = cust.select(F.col("c_custkey").alias("case"), (F.col("c_custkey") % 60).alias("region"))
    return o.case_checks(cases, cust.where("c_nationkey > 12").select(F.col("c_nationkey").alias("region")), orders.where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("case"), (F.col("o_orderkey") % 30).alias("region")))


def cases(spark, sf):
    """VAL-02, VAL-12."""
    return _case(spark, sf)


def production(spark, sf):
    """VAL-04, VAL-10."""
    one = lambda name, df, col=None: df.agg((F.coalesce(F.sum(col), F.lit(0)) if col else F.count("*")).cast("long").alias("issues")).withColumn("gate", F.lit(name))
    ready = o.interface_conformity(_candidates(spark, sf), _candidates(spark, sf).select("pair")).where("not conforms")
    return o.all_gates(one("bindings", o.binding_checks(_bindings(spark, sf)), "issues"), one("contact", o.contact_readiness(_orders(spark, sf).withColumnRenamed("id", "interface"), _materials(spark, sf))), one("conformity", ready))


QUERIES = {
    "rep_mesh": mesh, "rep_solid": solid, "rep_conditions": conditions, "rep_loads": loads, "rep_interfaces": interfaces, "rep_contact": contact, "rep_mapping": mapping, "rep_conformity": conformity, "rep_materialised": made,
    "rep_requests": requests, "rep_assets": assets, "rep_results": results, "rep_blocks": records, "rep_accepted": accepted, "rep_bindings": bound, "rep_cases": cases, "rep_production": production,
}
_CAND = f"{BOXES_SQL}, ct AS ({_CONTACTS}), c AS (SELECT axis, region_a, region_b, least(region_a, region_b) || '|' || greatest(region_a, region_b) AS pair, CASE WHEN region_a = region_b THEN 'tie' ELSE 'contact' END AS mode, area FROM ct)"
_CONTACT = f"""{_ORDERS}, {_MATS}, cr AS (SELECT id, CASE WHEN coalesce(o.material, '') = '' THEN 'interface.material_missing' WHEN m.material IS NULL THEN 'interface.material_undefined' WHEN NOT (kn > 0 AND ks > 0) THEN 'interface.stiffness_invalid' END AS code
FROM o LEFT JOIN m ON o.material = m.material)"""
_BOUND = f"""{_BIND}, bi AS (SELECT 'error' AS severity, 'binding.material_missing' AS code, k::VARCHAR AS t FROM p WHERE kind = 'solid' AND k % 5 = 0 UNION ALL SELECT 'error', 'binding.phase_missing', k::VARCHAR FROM p WHERE k % 7 = 0
UNION ALL SELECT 'warning', 'binding.role_missing', k::VARCHAR FROM p WHERE kind = 'face' AND k % 4 = 0)"""
SQL = {
    "rep_mesh": f"""WITH {_CELLS} SELECT count(*) AS cells, count(*) FILTER (WHERE lower(cell_type) IN ('hex8', 'tet4')) AS solid, count(*) FILTER (WHERE lower(cell_type) IN ('tri3', 'quad4')) AS surface, count(DISTINCT lower(cell_type)) AS types,
count(DISTINCT region) AS regions, count(DISTINCT material) AS materials FROM cells""",
    "rep_solid": """WITH l AS (SELECT l_orderkey AS model, CASE WHEN l_orderkey % 3 <> 0 THEN 'hex8' WHEN l_partkey % 2 = 0 THEN 'tri3' ELSE 'quad4' END AS t, CASE WHEN l_orderkey % 5 > 0 THEN 3 END AS d FROM lineitem
UNION ALL SELECT -o_orderkey, NULL, 3 FROM orders WHERE o_orderkey % 7 = 0), m AS (SELECT model, count(t) AS n, count(*) FILTER (WHERE t = 'hex8') AS s, count(*) FILTER (WHERE t IN ('tri3', 'quad4')) AS f, coalesce(max(d), 0) AS d FROM l GROUP BY model),
i AS (SELECT model, 'mesh.empty' AS code, 'error' AS severity FROM m WHERE n = 0 UNION ALL SELECT model, 'mesh.surface_only', 'error' FROM m WHERE f > 0 AND s = 0 UNION ALL SELECT model, 'mesh.dimension', 'warning' FROM m WHERE s > 0 AND d <> 3)
SELECT code, severity, count(*) AS models, min(model) AS first FROM i GROUP BY ALL""",
    "rep_conditions": f"""WITH {_ORDERS} SELECT count(*) AS conditions, CAST(sum(greatest(1, len(list_filter(string_split(replace(dof, ';', ','), ','), lambda t: trim(t) <> '')))) AS BIGINT) AS dofs, count(DISTINCT target) AS targets, count(DISTINCT stage) AS stages FROM o""",
    "rep_loads": f"""WITH {_ORDERS} SELECT CASE WHEN kind IN ('Body_Force', 'gravity') THEN 'body' WHEN kind IN ('nodal', 'point_load') THEN 'nodal' ELSE 'surface' END AS kind, count(*) AS loads, count(DISTINCT stage) AS stages FROM o GROUP BY 1""",
    "rep_interfaces": f"""WITH {_ORDERS}, {_MATS}, x AS (SELECT coalesce(mode, 'frictional') AS mode, nullif(material, '') AS material FROM o)
SELECT mode, count(*) AS interfaces, count(DISTINCT material) AS materials, count(DISTINCT material) FILTER (WHERE material NOT IN (SELECT material FROM m)) AS missing FROM x GROUP BY mode""",
    "rep_contact": f"WITH {_CONTACT} SELECT code, count(*) AS interfaces, max(id) AS last FROM cr WHERE code IS NOT NULL GROUP BY code",
    "rep_mapping": f"""WITH {_CELLS}, {_MATS}, k AS (SELECT material FROM m WHERE ks > 0 UNION SELECT 'mat_99'), c AS (SELECT nullif(material, '') AS material, count(*) AS cells FROM cells GROUP BY 1)
SELECT material, CASE WHEN material IS NULL THEN 'unmapped' WHEN material IN (SELECT material FROM k) THEN 'mapped' ELSE 'missing' END AS use, cells FROM c UNION ALL SELECT material, 'unused', 0 FROM k WHERE material NOT IN (SELECT material FROM c WHERE material IS NOT NULL)""",
    "rep_conformity": f"""WITH {_CAND}, d AS (SELECT DISTINCT pair FROM c WHERE mode = 'tie' OR axis = 'x') SELECT axis || '_' || mode AS mode, count(*) AS candidates, count(d.pair) AS materialised, count(*) = count(d.pair) AS conforms FROM c LEFT JOIN d ON c.pair = d.pair GROUP BY 1""",
    "rep_materialised": f"""WITH {_CAND}, n AS (SELECT DISTINCT region_a AS a, region_b AS b FROM c WHERE axis <> 'z' AND region_a <> region_b) SELECT 'interface_' || a || '_' || b AS interface, a, b, 'default_interface' AS material FROM n
WHERE NOT (b = 'Brand#11' AND a IN (SELECT region FROM boxes))""",
    "rep_requests": """WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 9 > 0 THEN o_custkey % 12 END AS a, o_custkey % 17 AS b, ['contact', 'tie', 'release', 'weld'][o_orderkey % 4 + 1] AS mode, o_orderkey % 3 = 0 AS exact FROM orders),
n AS (SELECT l_partkey % 12 AS a, l_suppkey % 9 + 12 AS b, CAST(max(l_quantity) % 3 AS BIGINT) AS shared FROM lineitem GROUP BY ALL),
f AS (SELECT least(a, b) AS na, greatest(a, b) AS nb, min(seq) AS first FROM r WHERE mode IN ('contact', 'tie') AND a <> b GROUP BY ALL),
s AS (SELECT CASE WHEN r.a IS NULL OR r.b IS NULL OR r.a = r.b THEN 'invalid' WHEN mode = 'release' THEN 'release' WHEN mode NOT IN ('contact', 'tie') THEN 'review' WHEN seq > first THEN 'present' WHEN exact AND coalesce(shared, 0) = 0 THEN 'pending' ELSE 'materialised' END AS status
FROM r LEFT JOIN n ON n.a = least(r.a, r.b) AND n.b = greatest(r.a, r.b) AND r.a IS NOT NULL LEFT JOIN f ON na = least(r.a, r.b) AND nb = greatest(r.a, r.b)) SELECT status, count(*) AS requests FROM s GROUP BY status""",
    "rep_assets": f"""WITH {_CAND}, a AS (SELECT pair, CASE mode WHEN 'tie' THEN 'continuity_tie' ELSE 'node_pair_contact' END AS request, CASE axis WHEN 'z' THEN 'merge' ELSE 'duplicate' END AS policy, sum(area) AS area FROM c GROUP BY ALL)
SELECT request, policy, count(*) AS assets, count(*) FILTER (WHERE area >= 2) AS ready, count(*) FILTER (WHERE area < 2) AS review, sum(area) AS area FROM a GROUP BY ALL""",
    "rep_results": """WITH f AS (SELECT user_id % 20 AS stage, count(DISTINCT event_type) AS fields, count(CASE WHEN event_id % 6 > 0 THEN value END) AS values FROM events GROUP BY 1),
m AS (SELECT n_nationkey AS stage, CASE WHEN n_nationkey % 3 = 0 THEN 1.0::DOUBLE WHEN n_nationkey % 3 < 2 THEN 2.0::DOUBLE END AS metric FROM nation)
SELECT coalesce(f.stage, m.stage) AS stage, coalesce(fields, 0) AS fields, coalesce(values, 0) AS values, metric FROM f FULL JOIN m ON f.stage = m.stage""",
    "rep_blocks": """SELECT p_brand AS region, count(*) AS objects, bool_and(p_partkey % 9 > 0) AS visible, bool_and(p_partkey % 2 = 0) AS locked, min(CASE WHEN p_partkey % 3 = 0 THEN p_type END) AS material, count(DISTINCT p_size % 6) AS stages FROM part GROUP BY 1""",
    "rep_accepted": """WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN 'not_valid' WHEN o_orderkey % 8 = 0 THEN 'benchmark' END AS reason FROM orders) SELECT reason IS NULL AS accepted, reason, count(*) AS packages FROM r GROUP BY ALL""",
    "rep_bindings": f"WITH {_BOUND} SELECT severity, code, count(*) AS issues, min(t) AS first FROM bi GROUP BY ALL",
    "rep_cases": """WITH s AS (SELECT o_custkey AS c, o_orderkey % 30 AS r FROM orders WHERE o_custkey % 5 <> 0), k AS (SELECT DISTINCT c_nationkey AS r FROM customer WHERE c_nationkey > 12),
i AS (SELECT 'error' AS severity, 'case.no_stage' AS code, c_custkey::VARCHAR AS t FROM customer WHERE c_custkey NOT IN (SELECT c FROM s) UNION ALL SELECT 'error', 'case.no_region', c_custkey::VARCHAR FROM customer WHERE c_custkey % 60 NOT IN (SELECT r FROM k)
UNION ALL SELECT 'warning', 'case.unknown_region', c::VARCHAR FROM s WHERE r NOT IN (SELECT r FROM k)) SELECT severity, code, count(*) AS issues, min(t) AS first FROM i GROUP BY ALL""",
    "rep_production": f"""WITH {_CONTACT}, {_BOUND}, g AS (SELECT 'bindings' AS gate, (SELECT count(*) FROM bi) AS issues UNION ALL SELECT 'contact', (SELECT count(*) FROM cr WHERE code IS NOT NULL) UNION ALL SELECT 'conformity', 0)
SELECT count(*) AS gates, count(*) FILTER (WHERE issues > 0) AS failed, string_agg(gate, ',' ORDER BY gate) FILTER (WHERE issues > 0) AS blockers, CASE WHEN count(*) FILTER (WHERE issues > 0) > 0 THEN 'blocked' ELSE 'ready' END AS status FROM g""",
}
