"""Block queries: axis-aligned boxes out of `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as b
from ..operators import geometry as g
from .views import BOXES_SQL, boxes

_PAIR = "FROM boxes a JOIN boxes b ON"
_CONTACTS = " UNION ALL ".join(
    f"SELECT '{k}' AS axis, a.id AS id_a, b.id AS id_b, a.region AS region_a, b.region AS region_b, (least(a.{u}1, b.{u}1) - greatest(a.{u}0, b.{u}0)) * (least(a.{v}1, b.{v}1) - greatest(a.{v}0, b.{v}0)) AS area "
    f"{_PAIR} a.{k}1 = b.{k}0 AND least(a.{u}1, b.{u}1) > greatest(a.{u}0, b.{u}0) AND least(a.{v}1, b.{v}1) > greatest(a.{v}0, b.{v}0)"
    for k, u, v in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))
)
_OVER = [f"(least(a.{k}1, b.{k}1) - greatest(a.{k}0, b.{k}0))" for k in "xyz"]


def contacts(spark, sf):
    """JOIN-03."""
    return b.block_contacts(boxes(spark, sf))


def contact_assets(spark, sf):
    """AGG-12, AGG-14."""
    return b.contact_assets(contacts(spark, sf))


def touching(spark, sf):
    """JOIN-05."""
    return b.touching_regions(boxes(spark, sf))


def splits(spark, sf):
    """GEN-14, GEN-16, GEN-17, PRJ-15."""
    return b.split_boxes(boxes(spark, sf), "x", 10.5).groupBy("side").agg(F.count("*").alias("blocks"), F.sum(g.box_volume()).alias("volume"))


def subtract(spark, sf):
    """GEN-12, JOIN-14: each box less one of half its size, moved a quarter."""
    box = boxes(spark, sf)
    cutter = box.withColumns(g.scaled_about_centre(0.5, 0.5, 0.5)).withColumns(g.translated(0.25, 0, 0)).select("id", *b.BOUNDS)
    return b.subtract_boxes(box, cutter).groupBy("part").agg(F.count("*").alias("slabs"), F.round(F.sum(g.box_volume()), 6).alias("volume"))


def regions(spark, sf):
    """AGG-06: cells and bounds of each region."""
    return boxes(spark, sf).groupBy("region").agg(F.count("*").alias("blocks"), *(f(c).alias(c) for k in "xyz" for f, c in ((F.min, f"{k}0"), (F.max, f"{k}1"))))


QUERIES = {"block_contacts": contacts, "block_contact_assets": contact_assets, "block_touching": touching, "block_splits": splits, "block_subtract": subtract, "block_regions": regions}
SQL = {
    "block_contacts": f"WITH {BOXES_SQL} {_CONTACTS}",
    "block_contact_assets": f"""WITH {BOXES_SQL}, c AS ({_CONTACTS}) SELECT least(region_a, region_b) AS low, greatest(region_a, region_b) AS high, count(*) AS contacts, sum(area) AS area,
count(*) FILTER (WHERE axis = 'x') AS axis_x, count(*) FILTER (WHERE axis = 'y') AS axis_y, count(*) FILTER (WHERE axis = 'z') AS axis_z,
CASE WHEN least(region_a, region_b) = greatest(region_a, region_b) THEN 'tie' ELSE 'contact' END AS mode FROM c GROUP BY 1, 2, 8""",
    "block_touching": f"WITH {BOXES_SQL} SELECT a.id AS id_a, b.id AS id_b {_PAIR} a.id < b.id AND {' AND '.join(f'{o} >= 0' for o in _OVER)} AND ({' OR '.join(f'{o} = 0' for o in _OVER)})",
    "block_splits": f"""WITH {BOXES_SQL}, s AS (SELECT x0, x1, y0, y1, z0, z1, CASE WHEN x0 < 10.5 AND x1 > 10.5 THEN unnest([0, 1]) END AS side FROM boxes WHERE x0 < 10.5 AND x1 > 10.5
UNION ALL SELECT x0, x1, y0, y1, z0, z1, NULL FROM boxes WHERE NOT (x0 < 10.5 AND x1 > 10.5))
SELECT side, count(*) AS blocks, sum(((CASE WHEN side = 0 THEN 10.5 ELSE x1 END) - (CASE WHEN side = 1 THEN 10.5 ELSE x0 END)) * (y1 - y0) * (z1 - z0)) AS volume FROM s GROUP BY side""",
    "block_subtract": f"""WITH {BOXES_SQL}, c AS (SELECT *, (x0 + x1) / 2 + (x0 - (x0 + x1) / 2) * 0.5 + 0.25 AS cx0, least(x1, (x0 + x1) / 2 + (x1 - (x0 + x1) / 2) * 0.5 + 0.25) AS cx1,
(y0 + y1) / 2 - (y1 - y0) / 4 AS cy0, (y0 + y1) / 2 + (y1 - y0) / 4 AS cy1, (z0 + z1) / 2 - (z1 - z0) / 4 AS cz0, (z0 + z1) / 2 + (z1 - z0) / 4 AS cz1 FROM boxes),
p AS (SELECT unnest([{{'part': 1, 'v': (cx0 - x0) * (y1 - y0) * (z1 - z0)}}, {{'part': 2, 'v': (x1 - cx1) * (y1 - y0) * (z1 - z0)}}, {{'part': 3, 'v': (cx1 - cx0) * (cy0 - y0) * (z1 - z0)}},
{{'part': 4, 'v': (cx1 - cx0) * (y1 - cy1) * (z1 - z0)}}, {{'part': 5, 'v': (cx1 - cx0) * (cy1 - cy0) * (cz0 - z0)}}, {{'part': 6, 'v': (cx1 - cx0) * (cy1 - cy0) * (z1 - cz1)}}]) AS p FROM c)
SELECT p.part AS part, count(*) AS slabs, round(sum(p.v), 6) AS volume FROM p WHERE p.v > 1e-12 GROUP BY 1""",
    "block_regions": f"WITH {BOXES_SQL} SELECT region, count(*) AS blocks, {', '.join(f'min({k}0) AS {k}0, max({k}1) AS {k}1' for k in 'xyz')} FROM boxes GROUP BY region",
}
