"""Fixture views: meshes, blocks, boreholes and stages derived from the provided tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh
from ..session import spread, table

NX = NY = 20

VOX_SQL = "vox AS (SELECT event_id % 20 AS i, (event_id // 20) % 20 AS j, event_id // 400 AS k, event_type AS label, value FROM events)"


def _node(di: int, dj: int, dk: int) -> str:
    return f"((k + {dk}) * 21 + j + {dj}) * 21 + i + {di}"


_CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
CELLS_SQL = VOX_SQL + f", cells AS (SELECT (k * 20 + j) * 20 + i AS cell_id, [{', '.join(_node(*c) for c in _CORNERS)}] AS conn, label AS region FROM vox)"
_FACES = ", ".join("list_sort([" + ", ".join(f"conn[{i + 1}]" for i in f) + "])" for f in mesh.FACES["hex8"])
FACES_SQL = CELLS_SQL + f""", faces AS (SELECT cell_id, region, unnest([{_FACES}]) AS face_key FROM cells),
uses AS (SELECT face_key, count(*) AS uses, min(region) AS region_a, max(region) AS region_b FROM faces GROUP BY face_key),
kinds AS (SELECT *, CASE WHEN uses = 1 THEN 'boundary' WHEN uses > 2 THEN 'nonmanifold' WHEN region_a = region_b THEN 'internal' ELSE 'interface' END AS kind FROM uses)"""


def vox(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select((e % NX).alias("i"), (F.floor(e / NX) % NY).alias("j"), F.floor(e / (NX * NY)).alias("k"), F.col("event_type").alias("label"), "value")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.hex_lattice(vox(spark, sf), NX, NY)


BOXES_SQL = """boxes AS (SELECT p_partkey AS id, p_brand AS region, p_type AS role, (p_partkey % 40)::DOUBLE AS x0, (p_partkey % 40 + 1 + p_size % 2)::DOUBLE AS x1,
((p_partkey // 40) % 25)::DOUBLE AS y0, ((p_partkey // 40) % 25 + 1)::DOUBLE AS y1, (p_partkey // 1000)::DOUBLE AS z0, (p_partkey // 1000 + 1)::DOUBLE AS z1 FROM part)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    low = {"x": k % 40, "y": F.floor(k / 40) % 25, "z": F.floor(k / 1000)}
    size = {"x": 1 + F.col("p_size") % 2, "y": F.lit(1), "z": F.lit(1)}
    bounds = [c.cast("double").alias(n) for a in "xyz" for n, c in ((f"{a}0", low[a]), (f"{a}1", low[a] + size[a]))]
    return spread(table(spark, sf, "part"), "p_partkey").select(k.alias("id"), F.col("p_brand").alias("region"), F.col("p_type").alias("role"), *bounds)


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
BH_SQL = f"""bh AS (SELECT l_orderkey AS borehole_id, l_suppkey % 7 AS layer_id, l_returnflag AS material_id, l_orderkey % 100 AS collar, rank() OVER w AS n,
round(sum(CAST(l_quantity AS BIGINT)) OVER w) - CAST(l_quantity AS BIGINT) AS top, round(sum(CAST(l_quantity AS BIGINT)) OVER w) AS bottom
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER} ROWS UNBOUNDED PRECEDING)),
lay AS (SELECT borehole_id, layer_id, material_id, (collar - top)::DOUBLE AS top, (collar - bottom)::DOUBLE AS bottom FROM bh)"""


def borehole_rows(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", ")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("l_quantity").cast("long")
    total = F.sum(q).over(w)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("borehole_id"), (F.col("l_suppkey") % 7).alias("layer_id"), F.col("l_returnflag").alias("material_id"),
        (F.col("l_orderkey") % 100).alias("collar"), (total - q).alias("top"), total.alias("bottom"),
    )


ACTIONS_SQL = """actions AS (SELECT user_id AS region, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS active FROM events)"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(F.col("user_id").alias("region"), F.row_number().over(w).alias("seq"), F.when(kind == "signup", True).when(kind == "error", False).alias("active"))


#: Six stresses by arithmetic on line items; the row's key is made of all its numbers.
STRESS_SQL = """stress AS (SELECT l_orderkey, l_linenumber, l_partkey, -l_quantity AS sxx, -2 * l_quantity AS syy, -l_extendedprice / 1000 AS szz,
l_discount * 10 AS txy, l_tax * 10 AS tyz, 0.5 AS txz, 5 + l_linenumber AS cohesion, 20 + l_quantity / 5 AS phi FROM lineitem)"""


def stress(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (-c("l_quantity")).alias("sxx"), (-2 * c("l_quantity")).alias("syy"), (-c("l_extendedprice") / 1000).alias("szz"),
        (c("l_discount") * 10).alias("txy"), (c("l_tax") * 10).alias("tyz"), F.lit(0.5).alias("txz"), (5 + c("l_linenumber")).alias("cohesion"), (20 + c("l_quantity") / 5).alias("phi"),
    )
