"""Column functions over points (struct<x,y,z>), cells (arrays of points) and axis-aligned boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def values(p: Column, axis: str) -> Column:
    """One coordinate of every point."""
    return F.transform(p, lambda q: q[axis])


def sub(a: Column, b: Column) -> Column:
    return point(*(a[k] - b[k] for k in AXES))


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def signed_tet_volume(p: Column) -> Column:
    """(b-a) x (c-a) . (d-a) / 6 of the first four points; zero or less is an inverted cell (PRJ-02)."""
    return dot(cross(sub(p[1], p[0]), sub(p[2], p[0])), sub(p[3], p[0])) / 6


def tet_volume(p: Column) -> Column:
    """Unsigned volume (PRJ-01)."""
    return F.abs(signed_tet_volume(p))


def bbox_volume(p: Column) -> Column:
    """Volume of the points' bounding box: a hexahedron's, if it is axis-aligned (PRJ-03)."""
    out = F.lit(1.0)
    for k in AXES:
        out = out * (F.array_max(values(p, k)) - F.array_min(values(p, k)))
    return out


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def polygon_area(p: Column) -> Column:
    """Sum of the fan's triangles from the first point; an overestimate for non-convex polygons (PRJ-08, PRJ-09)."""
    fan = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 2, F.lit(1))), lambda i: triangle_area(p[0], F.get(p, i), F.get(p, i + 1)))
    return F.when(F.size(p) >= 3, F.aggregate(fan, F.lit(0.0), lambda s, a: s + a)).otherwise(F.lit(0.0))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with the value worked out once, however often `of` names it."""
    return F.transform(F.array(value), of)[0]


def _unit(total: Column, none: Column) -> Column:
    unit = lambda t, n: F.when(n > 0, point(*(t[k] / n for k in AXES))).otherwise(none)
    return let(total, lambda t: let(norm(t), lambda n: unit(t, n)))


def polygon_normal(p: Column) -> Column:
    """Normalised sum of the cross products of neighbours, +z if that is zero (PRJ-10)."""
    total = lambda p: F.aggregate(
        F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: let(F.get(p, i), lambda a: let(F.get(p, (i + 1) % F.size(p)), lambda b: cross(a, b)))),
        point(F.lit(0), F.lit(0), F.lit(0)), lambda s, c: point(*(s[k] + c[k] for k in AXES)),
    )
    return let(p, lambda p: _unit(total(p), point(F.lit(0), F.lit(0), F.lit(1))))


def triangle_normal(p: Column) -> Column:
    """Unit normal of the first three points, zero if they are in line (PRJ-06, PRJ-07)."""
    return _unit(cross(sub(p[1], p[0]), sub(p[2], p[0])), point(F.lit(0), F.lit(0), F.lit(0)))


def centroid(p: Column) -> Column:
    """Mean of the points (PRJ-05)."""
    return point(*(F.aggregate(values(p, k), F.lit(0.0), lambda s, v: s + v) / F.size(p) for k in AXES))


def aspect_ratio(p: Column) -> Column:
    """Longest over shortest distance among all pairs of points, zero distances left out; null if none is left (PRJ-11, PRJ-12)."""
    far = lambda a, b: norm(sub(F.get(p, F.lit(a)), F.get(p, F.lit(b))))  # noqa: E731  (null beyond the last point)
    d = F.array(*(F.nullif(far(a, b), F.lit(0.0)) for b in range(8) for a in range(b)))  # cells have eight points at most
    return F.transform(F.array(d), lambda x: F.array_max(x) / F.array_min(x))[0]


def radius_ratio(p: Column) -> Column:
    """Proxy of a tetrahedron's shape: cube root of 12 volumes over the longest edge, clipped to [0, 1] (PRJ-14)."""
    longest = lambda p: F.array_max(F.flatten(F.transform(p, lambda a: F.transform(p, lambda b: norm(sub(a, b))))))
    ratio = lambda p, l: F.when(l > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(12 * tet_volume(p), F.lit(1 / 3)) / l))).otherwise(F.lit(0.0))  # noqa: E731, E741
    return let(p, lambda p: let(longest(p), lambda l: ratio(p, l)))  # noqa: E741


def cell_measure(kind: Column, p: Column) -> Column:
    """Volume or area by cell type; the bounding box's volume for unknown types (PRJ-04)."""
    return (
        F.when(kind == "tet4", tet_volume(p))
        .when(kind == "tri3", triangle_area(p[0], p[1], p[2]))
        .when(kind == "quad4", triangle_area(p[0], p[1], p[2]) + triangle_area(p[0], p[2], p[3]))
        .otherwise(bbox_volume(p))
    )


def signed_area_xy(p: Column) -> Column:
    """Shoelace area in the xy plane (PRJ-20)."""
    parts = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i)["x"] * F.get(p, (i + 1) % F.size(p))["y"] - F.get(p, (i + 1) % F.size(p))["x"] * F.get(p, i)["y"])
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2


def box_volume(prefix: str = "") -> Column:
    """Volume of a box in columns x0 to z1 (PRJ-15)."""
    out = F.lit(1.0)
    for k in AXES:
        out = out * (F.col(f"{prefix}{k}1") - F.col(f"{prefix}{k}0"))
    return out


def normalized_bounds() -> dict[str, Column]:
    """Columns x0 to z1 swapped so that the first of each axis is the smaller (PRJ-18)."""
    return {f"{k}{s}": f(F.col(f"{k}0"), F.col(f"{k}1")) for k in AXES for s, f in ((0, F.least), (1, F.greatest))}


def translated(dx: float, dy: float, dz: float) -> dict[str, Column]:
    """A box moved (PRJ-16)."""
    return {f"{k}{s}": F.col(f"{k}{s}") + d for k, d in zip(AXES, (dx, dy, dz), strict=True) for s in (0, 1)}


def scaled_about_centre(sx: float, sy: float, sz: float) -> dict[str, Column]:
    """A box scaled about its centre (PRJ-17)."""
    mid = lambda k: (F.col(f"{k}0") + F.col(f"{k}1")) / 2
    return {f"{k}{s}": mid(k) + (F.col(f"{k}{s}") - mid(k)) * f for k, f in zip(AXES, (sx, sy, sz), strict=True) for s in (0, 1)}


def snapped(value: Column, grid: float) -> Column:
    """Nearest multiple of `grid`, halves to even (PRJ-22)."""
    return F.rint(value / grid) * grid
