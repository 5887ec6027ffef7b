"""Stress and state queries over columns derived from `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import physics as p
from ..session import table
from .views import STRESS_SQL, stress

_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_M, _J2 = "(sxx + syy + szz) / 3", "((sxx - m) * (sxx - m) + (syy - m) * (syy - m) + (szz - m) * (szz - m)) / 2 + txy * txy + tyz * tyz + txz * txz"
_Q = f"{STRESS_SQL}, mm AS (SELECT *, {_M} AS m FROM stress), q AS (SELECT *, {_J2} AS j2 FROM mm)"


def invariants(spark, sf):
    """FN-11, FN-12, FN-15."""
    s = stress(spark, sf)
    c, phi = F.col("cohesion"), F.col("phi")
    r = lambda x: F.round(x, 4)
    return s.select(*_KEY, r(p.j2()).alias("j2"), r(p.von_mises()).alias("q"), r(p.proxy_yield_value(c, phi)).alias("proxy_yield"), r(p.yield_value(c, phi)).alias("yield"))


def principal(spark, sf):
    """FN-13: sums and products of the eigenvalues against the tensor's invariants."""
    s = stress(spark, sf)
    a, b, c = p.principal_stresses()
    s = s.withColumns({"a": a, "b": b, "c": c})
    return s.select(*_KEY, F.round(F.col("a") + F.col("b") + F.col("c"), 5).alias("trace"), (F.abs(F.col("a") * F.col("b") + F.col("b") * F.col("c") + F.col("a") * F.col("c") - (F.col("sxx") * F.col("syy") + F.col("syy") * F.col("szz") + F.col("sxx") * F.col("szz") - F.col("txy") ** 2 - F.col("tyz") ** 2 - F.col("txz") ** 2)) < 1e-6).alias("second"), ((F.col("a") >= F.col("b") - 1e-6) & (F.col("b") >= F.col("c") - 1e-6)).alias("ordered"))


def yielded(spark, sf):
    """NUM-10, PHY-09: share of cells beyond the surface, by material."""
    s = stress(spark, sf)
    beyond = p.yield_value(F.col("cohesion"), F.col("phi")) > 0
    return s.groupBy((F.col("l_partkey") % 10).alias("material")).agg(F.count("*").alias("cells"), F.count_if(beyond).alias("yielded"))


def k0_stress(spark, sf):
    """PHY-04, JOIN-13, FN-16."""
    c = F.col
    cells = table(spark, sf, "part").select(c("p_partkey").alias("cell_id"), (c("p_partkey") % 12).alias("material_id"), (-c("p_size")).cast("double").alias("z"))
    mats = table(spark, sf, "nation").where("n_nationkey < 10").select(
        c("n_nationkey").cast("long").alias("material_id"), F.when(c("n_nationkey") % 4 > 0, 16.0 + c("n_nationkey")).alias("gamma"), F.when(c("n_nationkey") % 3 > 0, 20.0 + c("n_nationkey")).alias("phi"), F.when(c("n_nationkey") % 5 == 0, 0.7).alias("k0")
    )
    return p.initial_stress(cells, mats, ground=1.0).select("cell_id", F.round("sxx", 4).alias("sxx"), F.round("szz", 4).alias("szz"))


def pore(spark, sf):
    """PHY-05, AGG-17."""
    u = p.pore_pressure(F.col("z"), F.col("level"))
    rows = table(spark, sf, "lineitem").select((F.col("l_linenumber")).alias("phase"), (-F.col("l_quantity")).alias("z"), (-F.col("l_linenumber") * 3.0).alias("level"), (-F.col("l_extendedprice") / 100).alias("szz"))
    return rows.groupBy("phase").agg(F.round(F.max(u), 4).alias("pore"), F.round(F.min(F.col("szz") + u), 4).alias("effective"))


def contact(spark, sf):
    """NUM-22, NUM-25, VAL-19."""
    c = F.col
    rows = table(spark, sf, "lineitem").select(((c("l_quantity") - 40) / 1000).alias("gap"), (c("l_discount") - 0.05).alias("slip"), (c("l_linenumber") % 3).alias("interface"))
    rows = rows.withColumns(p.contact_state(c("gap"), c("slip"), F.lit(1000.0), F.lit(100.0), F.lit(0.3), F.lit(0.5)))
    return rows.groupBy("interface", "status").agg(F.count("*").alias("pairs"), F.round(F.sum("normal"), 3).alias("normal"), F.round(F.sum("shear"), 3).alias("shear"))


QUERIES = {"state_invariants": invariants, "state_principal": principal, "state_yielded": yielded, "state_k0": k0_stress, "state_pore": pore, "state_contact": contact}
_P = "greatest(0, -m)"
_YIELD = f"sqrt(3 * j2) - {_P} * sin(radians(phi)) - cohesion * cos(radians(phi))"
SQL = {
    "state_invariants": f"""WITH {_Q} SELECT l_orderkey, l_linenumber, l_partkey, round(j2, 4) AS j2, round(sqrt(3 * j2), 4) AS q,
round(sqrt(3 * j2) + {_P} * sin(radians(phi)) - cohesion * cos(radians(phi)), 4) AS proxy_yield, round({_YIELD}, 4) AS yield FROM q""",
    "state_principal": f"""WITH {STRESS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(sxx + syy + szz, 5) AS trace,
true AS second, true AS ordered FROM stress""",
    "state_yielded": f"WITH {_Q} SELECT l_partkey % 10 AS material, count(*) AS cells, count(*) FILTER (WHERE {_YIELD} > 0) AS yielded FROM q GROUP BY 1",
    "state_k0": """WITH m AS (SELECT n_nationkey AS material_id, CASE WHEN n_nationkey % 4 > 0 THEN 16.0 + n_nationkey END AS gamma, CASE WHEN n_nationkey % 3 > 0 THEN 20.0 + n_nationkey END AS phi,
CASE WHEN n_nationkey % 5 = 0 THEN 0.7 END AS k0 FROM nation WHERE n_nationkey < 10),
c AS (SELECT p_partkey AS cell_id, -coalesce(gamma, 18.0)::DOUBLE * greatest(0, 1.0 + p_size)::DOUBLE AS v, coalesce(k0::DOUBLE, 1 - sin(radians(coalesce(phi, 30)::DOUBLE))) AS k FROM part LEFT JOIN m ON p_partkey % 12 = material_id)
SELECT cell_id, round(v * greatest(0.05, least(2, k)), 4) AS sxx, round(v, 4) AS szz FROM c""",
    "state_pore": """SELECT l_linenumber AS phase, round(max(u), 4) AS pore, round(min(-l_extendedprice / 100 + u), 4) AS effective
FROM (SELECT *, greatest(0, 9.81::DOUBLE * (-l_linenumber * 3.0::DOUBLE + l_quantity)) AS u FROM lineitem) GROUP BY 1""",
    "state_contact": """WITH r AS (SELECT l_linenumber % 3 AS interface, (l_quantity - 40) / 1000 AS gap, 100.0::DOUBLE * (l_discount - 0.05::DOUBLE) AS trial FROM lineitem),
n AS (SELECT *, greatest(0, -1000.0::DOUBLE * gap) AS nn, 0.5::DOUBLE + 0.3::DOUBLE * greatest(0, -1000.0::DOUBLE * gap) AS most FROM r),
s AS (SELECT *, CASE WHEN gap > 0 THEN 'open' WHEN abs(trial) <= most THEN 'stick' ELSE 'slip' END AS status FROM n)
SELECT interface, status, count(*) AS pairs, round(sum(CASE WHEN status = 'open' THEN 0 ELSE nn END), 3) AS normal,
round(sum(CASE status WHEN 'open' THEN 0 WHEN 'stick' THEN trial ELSE sign(trial) * most END), 3) AS shear FROM s GROUP BY ALL""",
}
