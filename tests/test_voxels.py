import itertools
import random

import pytest
from pyspark.sql import functions as F

from groundframe.operators import voxels as o
from groundframe.plans.voxels import CORNERS, TRIS


def box(x0, x1, y0, y1, z0, z1):
    at = dict(zip(("x0", "x1", "y0", "y1", "z0", "z1"), map(float, (x0, x1, y0, y1, z0, z1)), strict=True))
    c = [tuple(at[k] for k in names.split()) for names in CORNERS]
    return [[c[i] for i in t] for t in TRIS]


def frame(spark, regions):
    rows = [(r, n, t) for r, tris in regions.items() for n, t in enumerate(tris)]
    return spark.createDataFrame(rows, "region string, tri_id long, pts array<struct<x:double,y:double,z:double>>")


def filled(spark, regions, **how):
    t = frame(spark, regions)
    own = o.lattices(t, **how)
    vox, odd = o.inside(t, own)
    got = {}
    for r in vox.collect():
        got.setdefault(r["region"], []).append((r["i"], r["j"], r["k"]))
    assert all(len(v) == len(set(v)) for v in got.values())
    return {k: set(v) for k, v in got.items()}, {r["region"]: r["open"] for r in odd.collect()}


def test_edges_and_corners_on_the_lattice(spark):
    """Centres lie on edges and corners of the triangles: every voxel of touching boxes belongs to one of them."""
    parts = [(0, 2), (2, 3), (3, 6)]
    boxes = {f"{a}{b}{c}": box(*a, *b, *c) for a, b, c in itertools.product(parts, repeat=3)}
    far = [((-0.5, -0.5, -0.5),) * 3]  # the same lattice for all: a point without area at its corner, and one opposite
    far += [((6.5, 6.5, 6.5),) * 3]
    got, odd = filled(spark, {k: v + [list(t) for t in far] for k, v in boxes.items()}, size=1.0)
    assert not odd and sum(len(v) for v in got.values()) == 6**3 and len(set().union(*got.values())) == 6**3


def test_cavities_concave_shapes_and_holes(spark):
    hollow = box(0, 6, 0, 6, 0, 6) + box(2, 4, 2, 4, 2, 4)
    ell = box(0, 3, 0, 1, 0, 1) + box(0, 1, 1.0, 3, 0, 1)
    regions = {"hollow": hollow, "ell": ell, "open": box(0, 2, 0, 2, 0, 2)[:3] + box(0, 2, 0, 2, 0, 2)[4:], "flat": [[(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]]}
    got, odd = filled(spark, regions, size=0.5)
    assert len(got["hollow"]) == 12**3 - 4**3 and len(got["ell"]) == 6 * 2 * 2 + 2 * 4 * 2
    assert set(odd) == {"open"} and odd["open"] > 0 and "flat" not in got
    rep = {r["region"]: r for r in o.voxel_report(frame(spark, regions), size=0.5, most=1000).collect()}
    assert {k: r["status"] for k, r in rep.items()} == {"hollow": "too_large", "ell": "ok", "open": "open", "flat": "flat"}
    assert rep["ell"]["volume"] == pytest.approx(5.0)
    assert o.voxel_report(frame(spark, regions).limit(0)).count() == 0


def winding(tris, p):
    """Crossings of the ray above p, by areas in the plane."""
    n = 0
    for a, b, c in tris:
        area = lambda u, v: (v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0])
        s = (area(b, c), area(c, a), area(a, b))
        if min(s) > 0 or max(s) < 0:
            n += sum(w * q[2] for w, q in zip(s, (a, b, c), strict=True)) / sum(s) > p[2]
    return n % 2


def test_random_solids_equal_the_definition(spark):
    rng = random.Random(8)
    regions = {}
    for r in range(12):
        v = [tuple(rng.uniform(-3, 3) for _ in range(3)) for _ in range(4)]
        regions[str(r)] = [[v[a], v[b], v[c]] for a, b, c in ((0, 1, 2), (0, 1, 3), (1, 2, 3), (0, 2, 3))]
    t = frame(spark, regions)
    own = o.lattices(t, padding=0.3)
    got, odd = filled(spark, regions, padding=0.3)
    assert not odd
    for r in own.collect():
        at = lambda k, i: r[f"{k}0"] + (i + 0.5) * r["size"]  # noqa: E731, B023
        want = {(i, j, k) for i in range(r["nx"]) for j in range(r["ny"]) for k in range(r["nz"]) if winding(regions[r["region"]], (at("x", i), at("y", j), at("z", k)))}
        assert got.get(r["region"], set()) == want


def test_mesh_of_voxels(spark):
    t = frame(spark, {"a": box(0, 2, 0, 3, 0, 1)})
    own = o.lattices(t, size=1.0)
    cells, nodes = o.voxel_mesh(o.inside(t, own)[0], own)
    assert cells.count() == 6 and nodes.count() == 3 * 4 * 2
    b = nodes.agg(*(f(k) for k in "xyz" for f in (F.min, F.max))).first()
    assert tuple(b) == (0, 2, 0, 3, 0, 1)
