import random
import time

import pytest
from pyspark.sql import functions as F

from groundframe.operators import blocks, topology, transfer
from groundframe.operators.tiles import candidates, spans, tiled_join

SCHEMA = "id long, x0 double, x1 double, y0 double, y1 double"


def pairs(spark, rows):
    a, b = (spark.createDataFrame(rows, SCHEMA).select(*(F.col(c).alias(f"{n}_{c}") for c in ("id", "x0", "x1", "y0", "y1"))) for n in "ab")
    return tiled_join(a, b, spans("a_", "xy"), spans("b_", "xy"))


def test_every_pair_once_at_all_sizes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(250):
        size, x, y = 10.0 ** rng.uniform(-4, 3), rng.uniform(-50, 50), rng.uniform(-50, 50)
        rows.append((i, x, x + size, y, y + size * rng.choice([0, 0.01, 1])))
    rows += [(300, 0.0, 0.0, 0.0, 0.0), (301, 0.0, 0.0, 0.0, 0.0), (302, -0.0, 4.0, -4.0, 0.0), (303, 4.0, 8.0, 0.0, 4.0)]
    got = [(r["a_id"], r["b_id"]) for r in pairs(spark, rows).collect()]
    want = {(p[0], q[0]) for p in rows for q in rows if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs(spark, []).count() == 0


def boxes(spark, n, huge=True):
    side = round(n ** (1 / 3))
    k = F.col("id")
    at = {"x": k % side, "y": F.floor(k / side) % side, "z": F.floor(k / side**2)}
    small = spark.range(side**3).select(k, F.lit("small").alias("region"), *((2.0 * at[a] + s).alias(f"{a}{s}") for a in "xyz" for s in (0, 1)))
    if not huge:
        return small
    one = spark.createDataFrame([(10**9, "huge", -1e6, 1e6, -1e6, 1e6, -1e6, 0.0)], small.schema)  # all of the lowest layer stands on it
    return small.union(one)


def test_one_huge_box_among_many_small_ones(spark):
    start = time.perf_counter()
    df = boxes(spark, 46**3)
    assert df.count() == 46**3 + 1
    assert blocks.block_contacts(df).count() == 46**2 == topology.face_contacts(df).count() == blocks.touching_regions(df).count()
    assert time.perf_counter() - start < 240


@pytest.mark.parametrize("size", [0.001, 1.0, 5000.0])
def test_triangles_of_any_size(spark, size):
    rng = random.Random(4)
    tri = [[[rng.uniform(0, 4) * size for _ in range(3)] for _ in range(3)] for _ in range(60)] + [[[0.0, 0.0, 0.0], [400 * size, 0.0, 400 * size], [0.0, 400 * size, 0.0]]]
    df = spark.createDataFrame([(i, [3 * i, 3 * i + 1, 3 * i + 2], t) for i, t in enumerate(tri)], "cell_id long, conn array<long>, pts array<struct<x:double,y:double,z:double>>")
    lim = [[(min(p[k] for p in t), max(p[k] for p in t)) for k in range(3)] for t in tri]
    want = {(i, j) for i in range(61) for j in range(i + 1, 61) if all(lim[i][k][0] <= lim[j][k][1] and lim[j][k][0] <= lim[i][k][1] for k in range(3))}
    assert {tuple(r) for r in transfer.intersection_candidates(df).collect()} == want


def test_a_box_is_compared_with_its_surroundings_only(spark):
    """Boxes of a size just above a power of two, as tolerances make them: tiles are as wide as they need, not up to four times that."""
    df = boxes(spark, 12**3, huge=False).where("x0 >= 0")
    a, b = (df.select(*(F.col(c).alias(f"{n}_{c}") for c in ("id", "x0", "x1", "y0", "y1", "z0", "z1"))) for n in "ab")
    sides = [spans(f"{n}_", "xyz", 1e-6) for n in "ab"]
    assert tiled_join(a, b, *sides).count() == 12**3
    assert candidates(a, b, *sides).count() <= 27 * 12**3
