import random

import pytest

from groundframe.operators import outlines as o


def made(seed):
    rng = random.Random(seed)
    return [(f"o{k}", i, rng.choice([0.0, 1.0, 1.4, 2.0, 2.5, 7.0]) + rng.randrange(3) / 4, rng.choice([0.0, 1.0, 1.2, 5.0]) + rng.randrange(3) / 4, rng.choice([0.0, 1.0, 2.0])) for k in range(9) for i in range(rng.choice([1, 2, 40]) if k else 300)]


@pytest.fixture(params=["7", "10000"])
def batches(spark, request):  # batches end within outlines
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def frame(spark, rows):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "outline string, seq long, x double, y double, z double")


def by_outline(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(list(r))
    return out.values()


@pytest.mark.parametrize("prefer", ["nearest", "x", "y"])
def test_right_angles_equal_the_loop(spark, batches, prefer):
    rows = made(3)
    want = set()
    for points in by_outline(rows):
        for i, p in enumerate(points):
            axis = None
            if i:
                a = points[i - 1]
                axis = prefer if prefer in "xy" else "x" if abs(p[2] - a[2]) >= abs(p[3] - a[3]) else "y"
                p[2 if axis == "y" else 3] = a[2 if axis == "y" else 3]
            want.add((*p, axis))
    assert {tuple(r) for r in o.orthogonal(frame(spark, rows), prefer).collect()} == want


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 1.3])
def test_snapping_equals_the_loop(spark, batches, tolerance):
    """Of all earlier points, moved or not, the first one in reach."""
    rows = made(4)
    want, moved = set(), 0
    for points in by_outline(rows):
        for i, p in enumerate(points):
            hit = next((q for q in points[:i] if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= tolerance**2), None)
            if hit:
                p[2:5] = [hit[2], hit[3], p[4] or hit[4]]
                moved += 1
            want.add(tuple(p))
    got = o.snapped_to_earlier(frame(spark, rows), tolerance).collect()
    assert {tuple(r)[:5] for r in got} == want and sum(r["snapped_to"] is not None for r in got) == moved > 0


def test_edges_and_odd_rows(spark):
    rows = [("a", 1, 0.0, 0.0, 0.0), ("a", 5, 1.0, 0.0, 0.0), ("a", 9, 1.0, 1.26, 0.0), ("b", 1, 0.0, 0.0, 0.0), ("b", 2, 3.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), ("c", None, 0.0, 0.0, 0.0), ("d", 1, None, 0.0, 0.0)]
    df = frame(spark, rows)
    assert {tuple(r) for r in o.closed_edges(df).collect()} == {("a", 1, 1, 5), ("a", 2, 5, 9), ("a", 3, 9, 1)}
    assert {tuple(r) for r in o.closed_edges(df, close=False).collect()} == {("a", 1, 1, 5), ("a", 2, 5, 9)}
    assert {r["y"] for r in o.snapped_to_grid(df, 0.5).collect()} == {0.0, 1.5}
    assert o.orthogonal(df).count() == 6 == o.snapped_to_earlier(df, 1.0).count() and o.orthogonal(df.limit(0)).count() == 0
