"""Queries that edit outlines made of each user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outlines as o
from ..session import table

TOLERANCE = 7.0


def _points(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("outline"), e.alias("seq"), (e * 7919 % 101).cast("double").alias("x"), (e * 104729 % 97).cast("double").alias("y"), (e % 3).cast("double").alias("z"))


_P = "p AS (SELECT user_id AS outline, event_id AS seq, (event_id * 7919 % 101)::DOUBLE AS x, (event_id * 104729 % 97)::DOUBLE AS y, (event_id % 3)::DOUBLE AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


def edges(spark, sf):
    """PRJ-21: closed outlines."""
    return o.closed_edges(_points(spark, sf))


def grid(spark, sf):
    """PRJ-21: points on a grid."""
    return o.snapped_to_grid(_points(spark, sf), 2.5)


def right_angles(spark, sf):
    """PRJ-21: the sequential pass to right angles."""
    return o.orthogonal(_points(spark, sf))


def earlier(spark, sf):
    """PRJ-21: points moved to earlier ones."""
    return o.snapped_to_earlier(_points(spark, sf), TOLERANCE)


QUERIES = {"outline_edges": edges, "outline_grid": grid, "outline_orthogonal": right_angles, "outline_snapped": earlier}
SQL = {
    "outline_edges": f"""WITH {_P}, n AS (SELECT outline, count(*) AS n, min(seq) AS first FROM p GROUP BY outline HAVING count(*) >= 3)
SELECT outline, CAST(k AS INTEGER) AS k, seq AS start, coalesce(lead(seq) OVER (PARTITION BY outline ORDER BY seq), first) AS "end" FROM p JOIN n USING (outline)""",
    "outline_grid": f"WITH {_P} SELECT outline, seq, round_even(x / 2.5, 0) * 2.5 AS x, round_even(y / 2.5, 0) * 2.5 AS y, z FROM p",
    "outline_orthogonal": f"""WITH RECURSIVE {_P}, w AS (SELECT outline, seq, x, y, z, k, NULL::VARCHAR AS axis FROM p WHERE k = 1 UNION ALL SELECT p.outline, p.seq, CASE WHEN abs(p.x - w.x) >= abs(p.y - w.y) THEN p.x ELSE w.x END,
CASE WHEN abs(p.x - w.x) >= abs(p.y - w.y) THEN w.y ELSE p.y END, p.z, p.k, CASE WHEN abs(p.x - w.x) >= abs(p.y - w.y) THEN 'x' ELSE 'y' END FROM w JOIN p ON p.outline = w.outline AND p.k = w.k + 1) SELECT outline, seq, x, y, z, axis FROM w""",
    "outline_snapped": f"""WITH RECURSIVE {_P}, w AS (SELECT outline, seq, k, x, y, z, NULL::BIGINT AS snapped_to, [{{'x': x, 'y': y, 'z': z, 'seq': seq}}] AS stay FROM p WHERE k = 1
UNION ALL SELECT outline, seq, k, coalesce(hit.x, x), coalesce(hit.y, y), CASE WHEN z = 0 THEN coalesce(hit.z, z) ELSE z END, hit.seq, CASE WHEN hit IS NULL THEN list_append(stay, {{'x': x, 'y': y, 'z': z, 'seq': seq}}) ELSE stay END
FROM (SELECT p.*, stay, list_filter(stay, lambda s: (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= {TOLERANCE}::DOUBLE * {TOLERANCE}::DOUBLE)[1] AS hit FROM w JOIN p ON p.outline = w.outline AND p.k = w.k + 1))
SELECT outline, seq, x, y, z, snapped_to FROM w""",
}
