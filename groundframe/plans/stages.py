"""Stage queries: activation out of `events`, results out of `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stages as s
from ..session import table
from .views import ACTIONS_SQL, actions

_FOLD = f"{ACTIONS_SQL}, fold AS (SELECT *, coalesce(last_value(active IGNORE NULLS) OVER (PARTITION BY region ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS is_active FROM actions)"


def fold(spark, sf):
    """WIN-01, WIN-03, WIN-04."""
    return s.activation(actions(spark, sf)).select("region", "seq", "is_active")


def deltas(spark, sf):
    """SET-09."""
    return s.changes(s.activation(actions(spark, sf))).select("region", "seq", "change")


def active_counts(spark, sf):
    """AGG-32: active regions at each stage number, of those that have it."""
    return s.activation(actions(spark, sf)).groupBy("seq").agg(F.count("*").alias("regions"), F.count_if("is_active").alias("active"))


def fields(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("field"), F.when(F.col("o_orderkey") % 50 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("value"), "o_orderkey", "o_custkey")


def field_stats(spark, sf):
    """AGG-11: finite values only."""
    return s.field_statistics(fields(spark, sf)).withColumn("mean", F.round("mean", 4))


def curves(spark, sf):
    """WIN-07, WIN-08."""
    m = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("seq")).agg(F.count("*").alias("value"))
    c = s.metric_curves(m)
    return c.select("name", F.array_join("x", ",").alias("x"), F.array_join(F.transform("y", lambda v: v.cast("string")), ",").alias("y"))


def latest(spark, sf):
    """MUT-11, MUT-12."""
    return s.latest_results(fields(spark, sf), ["o_custkey", "stage"], ["o_orderkey"]).select("o_custkey", "stage", "o_orderkey")


QUERIES = {"stage_fold": fold, "stage_changes": deltas, "stage_active_counts": active_counts, "stage_field_stats": field_stats, "stage_curves": curves, "stage_latest": latest}
SQL = {
    "stage_fold": f"WITH {_FOLD} SELECT region, seq, is_active FROM fold",
    "stage_changes": f"""WITH {_FOLD}, b AS (SELECT *, coalesce(lag(is_active) OVER (PARTITION BY region ORDER BY seq), false) AS before FROM fold)
SELECT region, seq, CASE WHEN is_active THEN 'activated' ELSE 'deactivated' END AS change FROM b WHERE is_active <> before""",
    "stage_active_counts": f"WITH {_FOLD} SELECT seq, count(*) AS regions, count(*) FILTER (WHERE is_active) AS active FROM fold GROUP BY seq",
    "stage_field_stats": """SELECT o_orderpriority AS stage, o_orderstatus AS field, count(v) AS n, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean
FROM (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS v FROM orders) GROUP BY ALL""",
    "stage_curves": """SELECT name, string_agg(seq, ',' ORDER BY seq) AS x, string_agg(value::VARCHAR, ',' ORDER BY seq) AS y
FROM (SELECT o_orderstatus AS name, o_orderpriority AS seq, count(*) AS value FROM orders GROUP BY ALL) GROUP BY name""",
    "stage_latest": "SELECT o_custkey, o_orderpriority AS stage, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL",
}
