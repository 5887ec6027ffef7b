"""Matches of old and new entities: whole results, and work that follows the entities, not their pairs."""

import math
import random

from pyspark.sql import functions as F

from groundframe.operators import transfer as t

_KIND = "id long, x double, y double, z double, fingerprint long, key long, feature long, kind int, role int"


def entities(rng, n, sizes=(5, 4, 3)):
    pick = lambda k: None if rng.random() < 0.1 else rng.randrange(k)
    return [(i, *(float(rng.randrange(4)) for _ in "xyz"), *map(pick, sizes), pick(3), pick(2)) for i in rng.sample(range(10 * n), n)]


def brute(old, new, reach):
    out = {}
    for o in old:
        for n in new:
            same = [a is not None and a == b for a, b in zip(o[4:], n[4:], strict=True)]
            if any(same[:3]):
                score = sum(w for w, s in zip(t.SCORES.values(), same, strict=True) if s) + max(0.0, 2 * (1 - math.dist(o[1:4], n[1:4]) / reach))
                out[o[0]] = min(out.get(o[0], (math.inf,)), (-score, n[0]))
    return {(k, n, -less) for k, (less, n) in out.items()}


def test_best_matches_equal_brute_force(spark):
    rng = random.Random(3)
    old, new = entities(rng, 150), entities(rng, 400)
    got = t.best_matches(spark.createDataFrame(old, _KIND), spark.createDataFrame(new, _KIND), reach=3.0).collect()
    assert {(r["old_id"], r["new_id"], r["score"]) for r in got} == brute(old, new, 3.0) and len(got) == len({r["old_id"] for r in got})


def test_pairs_are_not_sorted_and_follow_the_places(spark):
    """Every pair of equal keys was met, and all of them sorted for the best one: 6 GB of tables failed by disk."""
    k = F.col("id")
    rows = lambda n: spark.range(n).select("id", (k % 10).cast("double").alias("x"), (k % 7).cast("double").alias("y"), F.lit(0.0).alias("z"), (k % 211).alias("fingerprint"), (k % 97).alias("key"), (k % 89).alias("feature"), (k % 5).alias("kind"), (k % 3).alias("role"))
    plan = t.best_matches(rows(50), rows(5_000), reach=5.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SortAggregate" not in plan
    old = rows(50).select(*(F.col(c).alias(f"old_{c}") for c in rows(1).columns))
    met = [t._scored(old, rows(n), ("feature",), ["kind", "role"], 5.0).count() for n in (50_000, 200_000)]
    assert met[0] <= met[1] <= 50 * 210  # 210 places, as many as a feature can have, instead of 2,248 entities
