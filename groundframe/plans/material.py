"""Queries on strains of moved lattices, material updates and contact stiffness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import material as m
from ..operators import mesh
from ..session import table
from .faces import _moved, _points, _tets
from .shapes import _INVARIANTS
from .views import CELLS_SQL, NX, NY, STRESS_SQL, cells, stress

_MOVES = {"ux": (31, 17), "uy": (37, 19), "uz": (41, 23)}


def _strained(spark, sf):
    c = cells(spark, sf).withColumn("young", 1000.0 + F.col("cell_id") % 7)
    n = F.col("node_id")
    moves = mesh.lattice_nodes(c, NX, NY).select("node_id", *(((n * a % b) / 1000.0).alias(k) for k, (a, b) in _MOVES.items()))
    out = m.cell_strains(c, _moved(c), moves)
    return out.withColumn("stress", m.hooke(F.col("young"), F.lit(0.25), F.col("strain")))


_U = ", ".join(f"(conn[{i + 1}] * {a} % {b}) / 1000.0::DOUBLE AS {k}{i}" for k, (a, b) in _MOVES.items() for i in range(4))


def _normal(k: str, i: int) -> str:
    """Component k of the cross product of the two edges from corner 0 other than i."""
    u, v = {"x": "yz", "y": "zx", "z": "xy"}[k]
    a, b = {1: (2, 3), 2: (3, 1), 3: (1, 2)}[i]
    return f"(({u}{a} - {u}0) * ({v}{b} - {v}0) - ({v}{a} - {v}0) * ({u}{b} - {u}0))"


def _slope(u: str, k: str) -> str:
    return "(" + " + ".join(f"({u}{i} - {u}0) * {_normal(k, i)}" for i in (1, 2, 3)) + ") / det"


_E = [_slope("ux", "x"), _slope("uy", "y"), _slope("uz", "z"), *(f"{_slope(u, k)} + {_slope(v, n)}" for u, k, v, n in (("ux", "y", "uy", "x"), ("uy", "z", "uz", "y"), ("ux", "z", "uz", "x")))]
_DET = " + ".join(f"({k}1 - {k}0) * {_normal(k, 1)}" for k in "xyz")
_STRAINED = f"""{CELLS_SQL}, t AS (SELECT cell_id, region, conn AS whole, unnest({_tets(mesh.HEX_TETS)}) AS conn FROM cells), p AS ({_points("t", 4, f"cell_id, region, whole, {_U}")}),
q AS (SELECT *, {_DET} AS det FROM p), e AS (SELECT cell_id, region, whole, abs(det) / 6 AS v, {", ".join(f"{x} AS e{i}" for i, x in enumerate(_E))} FROM q),
s AS (SELECT cell_id, any_value(region) AS region, any_value(whole) AS conn, 1000.0::DOUBLE + cell_id % 7 AS young, sum(v) AS volume, {", ".join(f"sum(v * e{i}) / sum(v) AS e{i}" for i in range(6))} FROM e GROUP BY cell_id),
h AS (SELECT *, young * 0.25 / (1.25 * 0.5) * (e0 + e1 + e2) AS bulk, young / 2.5 AS mu FROM s), st AS (SELECT *, {", ".join(f"bulk + 2 * mu * e{i} AS s{i}" for i in range(3))}, {", ".join(f"mu * e{i} AS s{i}" for i in range(3, 6))} FROM h)"""


def strains(spark, sf):
    """NUM-03, NUM-04, NUM-19: strains of hexahedra with moved nodes, and their stress."""
    s = _strained(spark, sf)
    mean = [F.round(F.avg(F.col("strain")[i]), 7).alias(f"e{i}") for i in range(6)]
    return s.groupBy("region").agg(F.count("strain").alias("cells"), F.round(F.sum("volume"), 5).alias("volume"), *mean, F.round(F.max(m.von_mises(F.col("stress"))), 4).alias("worst"))


def node_stress(spark, sf):
    """NUM-14: stresses back at the nodes."""
    n = m.node_means(_strained(spark, sf), "stress")
    return n.select("node_id", *(F.round(F.col("stress")[i], 4).alias(f"s{i}") for i in (0, 1, 2, 3)))


def elastic_step(spark, sf):
    """NUM-10: cells' states after an elastic increment, by material."""
    s = stress(spark, sf)
    six = F.array("sxx", "syy", "szz", "txy", "tyz", "txz").cast("array<double>")
    rows = s.select((F.col("l_partkey") % 10).alias("material"), six.alias("stress"), F.array(*[F.lit(0.0)] * 6).alias("strain"), _steps().alias("dstrain"), F.lit(2000.0).alias("young"), F.lit(0.2).alias("poisson"), "cohesion")
    out = m.advanced(rows, floor=10.0)
    return out.groupBy("material").agg(F.count("*").alias("cells"), F.count_if("yielded").alias("yielded"), F.round(F.avg("von_mises"), 4).alias("von_mises"), F.round(F.sum(F.col("strain")[0]), 5).alias("strain"))


#: A strain increment by arithmetic on a line item.
_STEP = ["(l_linenumber - 4) / 2000", "(l_partkey % 11 - 5) / 3000", "(l_orderkey % 13 - 6) / 2500", "(l_partkey % 5 - 2) / 4000", "(l_orderkey % 7 - 3) / 5000", "(l_linenumber % 3 - 1) / 4500"]


def _steps():
    return F.array(*(F.expr(e).cast("double") for e in _STEP))


_STEP_SQL = [e.replace(") / ", ")::DOUBLE / ") for e in _STEP]


def _soils(spark, sf):
    s = stress(spark, sf)
    six = F.array("sxx", "syy", "szz", "txy", "tyz", "txz").cast("array<double>")
    return s.select(
        (F.col("l_partkey") % 20).alias("material"), six.alias("stress"), _steps().alias("dstrain"), F.lit(20000.0).alias("young"), F.lit(0.3).alias("poisson"), F.col("cohesion").cast("double").alias("cohesion"),
        F.col("phi").cast("double").alias("friction"), F.lit(5.0).alias("dilation"), F.when(F.col("l_partkey") % 4 == 0, 8.0).otherwise(0.0).alias("tension"),
    )


def updates(spark, sf):
    """NUM-20, NUM-28, NUM-29: updates by material, elastic, torn and sheared, and the trial's distance from the surface."""
    out = m.yield_report(m.mohr_coulomb(_soils(spark, sf)), "material", more=(F.round(F.avg("update.margin"), 3).alias("margin"),))
    sheared = F.col("shear_single") + F.col("shear_edge") + F.col("shear_apex")
    return out.select("material", "cells", "yielded", F.round("share", 6).alias("share"), "elastic", "tension", sheared.alias("sheared"), "margin")


def modes(spark, sf):
    """NUM-20, NUM-29: updates by active planes; what returns lies on the surface afterwards."""
    out = m.mohr_coulomb(_soils(spark, sf))
    u = F.col("update")
    return out.groupBy("material", u["mode"].alias("mode"), u["planes"].alias("planes")).agg(
        F.count("*").alias("cells"), F.round(F.avg(u["multiplier"]), 9).alias("multiplier"), F.round(F.avg(u["stress"][2]), 5).alias("szz"), F.round(F.avg(u["plastic"][0]), 9).alias("plastic")
    )


def tangents(spark, sf):
    """NUM-23: consistent tangents of the rows' stresses, by material."""
    out = m.consistent_tangent(_soils(spark, sf))
    return out.groupBy("material").agg(F.count("*").alias("rows"), F.count_if("regularised").alias("regularised"), F.round(F.avg(F.col("tangent")[0]), 0).alias("first"), F.round(F.avg(F.col("tangent")[35]), 0).alias("last"))


def histories(spark, sf):
    """NUM-21: each user's events as strain increments of a soil in order of time; the state after the last."""
    e = F.col("event_id")
    part = lambda a, b, s: ((e * a % b - (b - 1) / 2) / s).cast("double")
    de = F.array(part(7, 11, 9000), part(13, 17, 12000), part(19, 23, 15000) - 0.0004, part(3, 5, 4000), part(5, 7, 6000), part(11, 13, 8000))
    soil = {"young50": 2e4, "young_oed": 2e4, "young_ur": 6e4, "poisson": 0.2, "p_ref": 100.0, "power": 0.5, "cohesion": 5.0, "friction": 28.0, "dilation": 2.0, "shear0": 1e5, "gamma07": 2e-4, "failure": 0.9}
    rows = table(spark, sf, "events").select(F.col("user_id").alias("cell"), F.struct("ts", "event_id").alias("seq"), de.alias("dstrain"), *(F.lit(v).alias(k) for k, v in soil.items()))
    last = m.hardening_history(rows).groupBy("cell").agg(F.count("*").alias("steps"), F.max_by("state", "seq").alias("s"))
    return last.select("cell", "steps", "s.mode", F.round("s.p", 4).alias("p"), F.round("s.q", 4).alias("q"), F.round("s.eps_eq", 7).alias("eps_eq"), F.round("s.gamma_hist", 7).alias("gamma_hist"), F.round(F.col("s.stress")[2], 4).alias("szz"))


def _pairs(spark, sf):
    k, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    s, d = part % 50, k % 40
    node = lambda n, z, dx, dz: F.struct((n % 7).cast("double").alias("x"), (n % 5).cast("double").alias("y"), F.lit(z).alias("z"), dx.alias("ux"), F.lit(0.001).alias("uy"), dz.alias("uz"))
    return table(spark, sf, "lineitem").select(
        (line % 3).alias("interface"), s.alias("slave"), d.alias("master"), (1000.0 + line).alias("kn"), (100.0 + line).alias("ks"), F.lit(25.0).alias("friction"), F.lit(0.5).alias("cohesion"),
        node(s, 0.0, (part % 9 - 4) / 900.0, F.lit(0.0)).alias("s"), node(s, 0.5, (k % 9 - 4) / 700.0, (k % 11 - 8) / 10.0).alias("m"),
    )


_PAIRS = """r AS (SELECT l_linenumber % 3 AS interface, l_partkey % 50 AS slave, l_orderkey % 40 AS master, 1000.0::DOUBLE + l_linenumber AS kn, 100.0::DOUBLE + l_linenumber AS ks,
(l_orderkey % 9 - 4) / 700.0::DOUBLE - (l_partkey % 9 - 4) / 900.0::DOUBLE AS jx, 0.5::DOUBLE + (l_orderkey % 11 - 8) / 10.0::DOUBLE AS gap FROM lineitem),
a AS (SELECT *, ks * abs(jx) AS size, greatest(0, -kn * gap) AS force, 0.5::DOUBLE + tan(radians(25.0::DOUBLE)) * greatest(0, -kn * gap) AS lim FROM r),
c AS (SELECT *, CASE WHEN gap > 1e-9 THEN 'open' WHEN size <= lim + 1e-12 THEN 'stick' ELSE 'slip' END AS status FROM a)"""


def triplets(spark, sf):
    """NUM-24: the stiffness of all contacts, summed by row and column."""
    out = m.contact_triplets(m.contact_pairs(_pairs(spark, sf)))
    return out.select("row", "col", (F.round("value", 3) + F.lit(0.0)).alias("value"))


def contacts(spark, sf):
    """NUM-22, NUM-24: contacts by interface and state."""
    out = m.contact_report(m.contact_pairs(_pairs(spark, sf)), "interface")
    return out.select("interface", "pairs", "open", "stick", "slip", "same", *(F.round(k, 6).alias(k) for k in ("least_gap", "greatest_gap", "greatest_force")))


QUERIES = {
    "strain_cells": strains, "strain_nodes": node_stress, "state_elastic_step": elastic_step, "mc_updates": updates, "mc_modes": modes, "mc_tangents": tangents,
    "soil_histories": histories, "contact_triplets": triplets, "contact_states": contacts,
}
_NPHI = "((1 + sin(radians(phi))) / (1 - sin(radians(phi))))"
#: The trial stress in the columns that the invariants read, then its eigenvalues, greatest first.
_TRIAL = f"""{STRESS_SQL.replace("stress AS", "given AS", 1)}, d AS (SELECT given.*, {", ".join(f"{x} AS d{i}" for i, x in enumerate(_STEP_SQL))} FROM given),
stress AS (SELECT l_partkey, cohesion, phi, 20000.0::DOUBLE / 2.6 AS mu, {", ".join(f"s{k}{k} + 20000.0::DOUBLE * 0.3 / (1.3 * 0.4) * (d0 + d1 + d2) + 2 * 20000.0::DOUBLE / 2.6 * d{i} AS s{k}{k}" for i, k in enumerate("xyz"))},
{", ".join(f"t{k} + 20000.0::DOUBLE / 2.6 * d{i + 3} AS t{k}" for i, k in enumerate(("xy", "yz", "xz")))} FROM d), {_INVARIANTS},
p AS (SELECT *, mean + 2 * r * cos(th) AS a, mean + 2 * r * cos(th - 2 * pi() / 3) AS b, mean + 2 * r * cos(th + 2 * pi() / 3) AS c, CASE WHEN l_partkey % 4 = 0 THEN 8.0 ELSE 0 END AS cut FROM l),
f AS (SELECT *, greatest(-c + {_NPHI} * b, -b + {_NPHI} * a, -c + {_NPHI} * a) - 2 * cohesion * sqrt({_NPHI}) AS f, cut > 0 AND a > cut AS torn FROM p)"""
SQL = {
    "strain_cells": f"""WITH {_STRAINED} SELECT region, count(*) AS cells, round(sum(volume), 5) AS volume, {", ".join(f"round(avg(e{i}), 7) AS e{i}" for i in range(6))},
round(max(sqrt(0.5 * ((s0 - s1) * (s0 - s1) + (s1 - s2) * (s1 - s2) + (s2 - s0) * (s2 - s0)) + 3 * (s3 * s3 + s4 * s4 + s5 * s5))), 4) AS worst FROM st GROUP BY region""",
    "strain_nodes": f"WITH {_STRAINED}, n AS (SELECT unnest(conn) AS node_id, * FROM st) SELECT node_id, {', '.join(f'round(sum(volume * s{i}) / sum(volume), 4) AS s{i}' for i in range(4))} FROM n GROUP BY node_id",
    "state_elastic_step": f"""WITH {STRESS_SQL}, d AS (SELECT *, {", ".join(f"{x} AS d{i}" for i, x in enumerate(_STEP_SQL))} FROM stress),
e AS (SELECT *, 2000.0::DOUBLE * 0.2 / (1.2 * 0.6) * (d0 + d1 + d2) AS bulk, 2000.0::DOUBLE / 2.4 AS mu FROM d), n AS (SELECT l_partkey % 10 AS material, cohesion, d0, sxx + bulk + 2 * mu * d0 AS a, syy + bulk + 2 * mu * d1 AS b, szz + bulk + 2 * mu * d2 AS c, txy + mu * d3 AS x, tyz + mu * d4 AS y, txz + mu * d5 AS z FROM e),
v AS (SELECT *, sqrt(0.5 * ((a - b) * (a - b) + (b - c) * (b - c) + (c - a) * (c - a)) + 3 * (x * x + y * y + z * z)) AS vm FROM n)
SELECT material, count(*) AS cells, count(*) FILTER (WHERE vm > greatest(6 * cohesion, 10.0)) AS yielded, round(avg(vm), 4) AS von_mises, round(sum(d0), 5) AS strain FROM v GROUP BY material""",
    "mc_updates": f"""WITH {_TRIAL} SELECT l_partkey % 20 AS material, count(*) AS cells, count(*) FILTER (WHERE torn OR f > 0) AS yielded, round(count(*) FILTER (WHERE torn OR f > 0) / count(*), 6) AS share, count(*) FILTER (WHERE NOT torn AND f <= 0) AS elastic,
count(*) FILTER (WHERE torn) AS tension, count(*) FILTER (WHERE NOT torn AND f > 0) AS sheared, round(avg(f), 3) AS margin FROM f GROUP BY 1""",
    "contact_triplets": f"""WITH {_PAIRS}, k AS (SELECT *, [CASE WHEN status = 'stick' THEN ks ELSE 0 END, CASE WHEN status = 'stick' THEN ks ELSE ks * lim / size END, kn] AS diag FROM c WHERE status <> 'open' AND slave <> master),
e AS (SELECT slave, master, unnest([0, 1, 2]) AS i, unnest(diag) AS v FROM k), x AS (SELECT 3 * slave + i AS row, 3 * slave + i AS col, v FROM e UNION ALL SELECT 3 * master + i, 3 * master + i, v FROM e
UNION ALL SELECT 3 * slave + i, 3 * master + i, -v FROM e UNION ALL SELECT 3 * master + i, 3 * slave + i, -v FROM e)
SELECT row, col, round(sum(v), 3) + 0.0 AS value FROM x WHERE v <> 0 GROUP BY row, col""",
    "contact_states": f"""WITH {_PAIRS} SELECT interface, count(*) AS pairs, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'stick') AS stick, count(*) FILTER (WHERE status = 'slip') AS slip,
count(*) FILTER (WHERE slave = master) AS same, round(min(gap), 6) AS least_gap, round(max(gap), 6) AS greatest_gap, round(max(force), 6) AS greatest_force FROM c GROUP BY interface""",
}
