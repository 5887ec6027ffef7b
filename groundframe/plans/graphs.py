"""Queries on graphs of customers and on boundaries of sheets of grid cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as o
from ..session import table
from .views import VOX_SQL, vox


def sheets(spark, sf):
    """Two triangles for every grid cell that is there, in a sheet for each layer; cells that touch in a corner make loops meet."""
    v = vox(spark, sf).where((F.col("i") * 7 + F.col("j") * 13 + F.floor("value") + F.col("k") * 5) % 3 > 0)
    n = lambda di, dj: (F.col("k") * 21 + F.col("j") + dj) * 21 + F.col("i") + di
    return v.select(F.explode(F.array(F.array(n(0, 0), n(1, 0), n(1, 1)), F.array(n(0, 0), n(1, 1), n(0, 1)))).alias("conn"))


_DARTS = f"""{VOX_SQL}, q AS (SELECT (k * 21 + j) * 21 + i AS n FROM vox WHERE (i * 7 + j * 13 + floor(value) + k * 5) % 3 > 0), t AS (SELECT unnest([[n, n + 1, n + 22], [n, n + 22, n + 21]]) AS t FROM q),
u AS (SELECT list_sort(unnest([[t[1], t[2]], [t[2], t[3]], [t[3], t[1]]])) AS e FROM t), b AS (SELECT e[1] AS a, e[2] AS b FROM u GROUP BY e HAVING count(*) = 1),
s AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM (SELECT a, b FROM b UNION ALL SELECT b, a FROM b)),
d AS (SELECT x.a, x.b, y.b AS c FROM s x JOIN s y ON x.a = y.a AND y.r = x.r + CASE WHEN x.r % 2 = 1 THEN 1 ELSE -1 END),
w AS (SELECT a AS sa, b AS sb, a, b, 0::BIGINT AS n FROM d UNION ALL SELECT w.sa, w.sb, d.a, d.c, w.n + 1 FROM w JOIN d ON d.a = w.b AND d.b = w.a WHERE (d.a, d.c) > (w.sa, w.sb)),
z AS (SELECT w.sa, w.sb FROM w JOIN d ON d.a = w.b AND d.b = w.a WHERE d.a = w.sa AND d.c = w.sb), f AS (SELECT w.* FROM w JOIN z ON w.sa = z.sa AND w.sb = z.sb),
m AS (SELECT least(a, b) AS x, greatest(a, b) AS y, min((sa, sb)) AS first FROM f GROUP BY ALL), g AS (SELECT f.* FROM f JOIN m ON least(f.a, f.b) = x AND greatest(f.a, f.b) = y AND (sa, sb) = first)"""


def loops(spark, sf):
    """GRA-02: every boundary edge with its place in its loop."""
    return o.traced(o.boundary_edges(sheets(spark, sf)))


def loop_sizes(spark, sf):
    """GRA-02: the loops, and their edges."""
    return o.boundary_loops(sheets(spark, sf))


def links(spark, sf):
    """Chains of thirteen customers, some of which meet."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    chain = c.where(k % 13 > 0).select(k.alias("source"), (k + 1).alias("target"), F.col("c_mktsegment").alias("relation"))
    return chain.union(c.where(k % 31 == 0).select(k, k + 26, F.lit("far")))


_LINKS = "l AS (SELECT c_custkey AS a, c_custkey + 1 AS b, c_mktsegment AS rel FROM customer WHERE c_custkey % 13 > 0 UNION ALL SELECT c_custkey, c_custkey + 26, 'far' FROM customer WHERE c_custkey % 31 = 0), e AS (SELECT a, b, rel FROM l UNION ALL SELECT b, a, rel FROM l)"


def groups(spark, sf):
    """GRA-01: the smallest customer reachable."""
    return o.components(links(spark, sf))


def around(spark, sf):
    """GRA-03: neighbours over some of the relations."""
    return o.neighbours(links(spark, sf), ["far", "BUILDING", "MACHINERY"])


QUERIES = {"graph_loops": loops, "graph_loop_sizes": loop_sizes, "graph_components": groups, "graph_neighbours": around}
SQL = {
    "graph_loops": f"WITH RECURSIVE {_DARTS} SELECT sa AS first, sb AS second, n AS place, a AS source, b AS target, true AS closed FROM g",
    "graph_loop_sizes": f"WITH RECURSIVE {_DARTS} SELECT sa AS first, sb AS second, true AS closed, count(*) AS edges FROM g GROUP BY ALL",
    "graph_components": f"WITH RECURSIVE {_LINKS}, r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node",
    "graph_neighbours": f"WITH {_LINKS} SELECT DISTINCT a AS node, b AS other FROM e WHERE rel IN ('far', 'BUILDING', 'MACHINERY')",
}
