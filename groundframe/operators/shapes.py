"""Plane cuts, polygons, outlines, transforms on import and selectors of volumes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as g
from .tiles import spans, tiled_join
from .topology import BOX_EDGES, CORNERS

#: Roles of volumes that are soil, and of those that cut it (fixed values).
SOIL_ROLES = ("soil", "rock", "geology", "ground")
CUTTER_ROLES = ("wall", "beam", "strut", "anchor", "structure", "excavation")


def plane_cut(boxes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """`boxes` with `polygon`: the points in which the plane (columns px, py, pz, nx, ny, nz) meets their edges, in order around its centre (GEN-13, SPA-05).

    Each of the twelve edges is cut at most once; points that agree in nine digits are one. Fewer than three are no polygon (null).
    """
    corner = [g.point(*(F.col(f"{k}{s}") for k, s in zip(g.AXES, c, strict=True))) for c in CORNERS]
    n, p = g.point(F.col("nx"), F.col("ny"), F.col("nz")), g.point(F.col("px"), F.col("py"), F.col("pz"))
    out = boxes.withColumn("corner", F.array(*(F.struct(c.alias("c"), g.dot(g.sub(c, p), n).alias("d")) for c in corner)))

    def cut(a: int, b: int) -> Column:
        u, w = F.col("corner")[a], F.col("corner")[b]
        t = u["d"] / (u["d"] - w["d"])
        at = g.point(*(F.round(u["c"][k] + t * (w["c"][k] - u["c"][k]), 9) + F.lit(0.0) for k in g.AXES))
        return F.when((F.least(u["d"], w["d"]) <= tolerance) & (F.greatest(u["d"], w["d"]) >= -tolerance) & (F.abs(u["d"] - w["d"]) > tolerance), at)

    out = out.withColumn("hits", F.array_distinct(F.array_compact(F.array(*(cut(a, b) for a, b in BOX_EDGES))))).drop("corner")
    out = out.withColumn("ring", angular_order(F.col("hits"), n))
    return out.withColumn("polygon", F.when(F.size("hits") >= 3, F.col("ring"))).drop("hits", "ring")


def angular_order(points: Column, normal: Column) -> Column:
    """Points of a plane sorted by their angle around their centre, in a basis of the plane; ties by the point (SRT-03)."""
    # the axis that the normal has least of gives the first direction
    least = F.least(*(F.abs(normal[k]) for k in g.AXES))
    axis = F.when(F.abs(normal["x"]) == least, g.point(F.lit(1), F.lit(0), F.lit(0))).when(F.abs(normal["y"]) == least, g.point(F.lit(0), F.lit(1), F.lit(0))).otherwise(g.point(F.lit(0), F.lit(0), F.lit(1)))
    basis = F.transform(F.array(axis), lambda a: F.struct(g.cross(normal, a).alias("u"), g.centroid(points).alias("c")))
    basis = F.transform(basis, lambda b: F.struct(b["u"].alias("u"), g.cross(normal, b["u"]).alias("v"), b["c"].alias("c"), g.norm(normal).alias("l")))

    def placed(b: Column) -> Column:
        angle = lambda q: F.atan2(g.dot(g.sub(q, b["c"]), b["v"]), g.dot(g.sub(q, b["c"]), b["u"]) * b["l"])
        return F.transform(F.array_sort(F.transform(points, lambda q: F.struct(angle(q).alias("angle"), q.alias("q")))), lambda x: x["q"])

    return F.transform(basis, placed)[0]


def segments_cross(a: Column, b: Column, c: Column, d: Column, eps: float = 1e-9) -> Column:
    """Whether segments ab and cd (points of the xy plane) cross: the ends of each lie on different sides of the other by more than eps (SPA-07)."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    apart = lambda s, t: ((s > eps) & (t < -eps)) | ((s < -eps) & (t > eps))
    return apart(side(a, b, c), side(a, b, d)) & apart(side(c, d, a), side(c, d, b))


def outline_checks(points: DataFrame) -> DataFrame:
    """Per outline (outline, seq, x, y): points, signed area, crossings of its edges and points that repeat one (GRA-06, PRJ-20, PRJ-21).

    The outline closes from its last point to its first. Edges of one outline meet each other by bins of its extent, so that the
    work is far below all pairs for long outlines.
    """
    w = Window.partitionBy("outline").orderBy("seq")
    whole = Window.partitionBy("outline").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct("x", "y")
    e = points.select("outline", "seq", p.alias("a"), F.coalesce(F.lead(p).over(w), F.first(p).over(whole)).alias("b"), F.row_number().over(w).alias("k"))
    area = e.groupBy("outline").agg(F.count("*").alias("points"), (F.sum(F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")) / 2).alias("area"))
    same = points.groupBy("outline", F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).count().groupBy("outline").agg(F.sum(F.col("count") - 1).alias("repeated"))
    size = e.groupBy("outline").agg(F.greatest(F.avg(F.abs(F.col("a.x") - F.col("b.x"))), F.avg(F.abs(F.col("a.y") - F.col("b.y"))), F.lit(1e-9)).alias("bin"))
    t = e.join(size, "outline")
    for k in "xy":
        low, high = F.least(f"a.{k}", f"b.{k}"), F.greatest(f"a.{k}", f"b.{k}")
        t = t.withColumns({f"lo_{k}": low, f"t{k}": F.explode(F.sequence(F.floor(low / F.col("bin")), F.floor(high / F.col("bin"))))})
    one, two = (t.select("outline", "bin", "tx", "ty", *(F.col(c).alias(f"{n}{c}") for c in ("k", "a", "b", "lo_x", "lo_y"))) for n in ("", "o_"))
    first = reduce(lambda x, y: x & y, (F.col(f"t{k}") == F.floor(F.greatest(f"lo_{k}", f"o_lo_{k}") / F.col("bin")) for k in "xy"))
    hit = (F.col("k") < F.col("o_k")) & first & segments_cross(F.col("a"), F.col("b"), F.col("o_a"), F.col("o_b"))
    crossings = one.join(two.drop("bin"), ["outline", "tx", "ty"]).where(hit).groupBy("outline").agg(F.count("*").alias("crossings"))
    return area.join(same, "outline").join(crossings, "outline", "left").fillna(0, ["crossings"])


def offset_outline(points: DataFrame, offset: float, most_miter: float = 4.0) -> DataFrame:
    """`points` (outline, seq, x, y) with ox, oy: the outline moved by `offset` to the right of its edges, corners mitred up to `most_miter` offsets (GEN-34)."""
    w = Window.partitionBy("outline").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct("x", "y")
    own = points.withColumns({"next": F.coalesce(F.lead(p).over(w), F.first(p).over(whole)), "before": F.coalesce(F.lag(p).over(w), F.last(p).over(whole))})
    dx1, dy1, dx2, dy2 = F.col("x") - F.col("before.x"), F.col("y") - F.col("before.y"), F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y")
    l1, l2 = F.sqrt(dx1**2 + dy1**2), F.sqrt(dx2**2 + dy2**2)
    unit = lambda v, n: F.when(n > 0, v / n).otherwise(0.0)
    own = own.withColumns({"n1x": unit(dy1, l1), "n1y": -unit(dx1, l1), "n2x": unit(dy2, l2), "n2y": -unit(dx2, l2)})
    own = own.withColumns({"mx": F.col("n1x") + F.col("n2x"), "my": F.col("n1y") + F.col("n2y")})
    # the miter runs along the sum of the normals, and is longer the sharper the corner
    along = F.col("mx") * F.col("n2x") + F.col("my") * F.col("n2y")
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2)
    scale = F.when(along > 1e-12, F.least(1 / along, most_miter / F.greatest(size, F.lit(1e-12)))).otherwise(0.0)
    return own.select("outline", "seq", "x", "y", (F.col("x") + offset * F.col("mx") * scale).alias("ox"), (F.col("y") + offset * F.col("my") * scale).alias("oy"))


def panels(points: DataFrame, low: float, high: float) -> DataFrame:
    """A vertical panel for every pair of neighbouring points of a line (line, seq, x, y): (line, seq, length, area) (GEN-15)."""
    w = Window.partitionBy("line").orderBy("seq")
    p = points.withColumn("next", F.lead(F.struct("x", "y")).over(w)).where("next is not null")
    length = F.sqrt((F.col("next.x") - F.col("x")) ** 2 + (F.col("next.y") - F.col("y")) ** 2)
    return p.select("line", "seq", length.alias("length"), (length * (high - low)).alias("area"))


def polygon_box(points: DataFrame, pad: float = 0.5) -> DataFrame:
    """Per outline: its bounding box, which stands for it where boxes are split; y is padded (GEN-18)."""
    return points.groupBy("outline").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))


def transformed(scale: Column, degrees: Column, move: Column) -> dict[str, Column]:
    """Columns x0 to z1 of a box after scaling, turning around z and moving: the bounds of its eight corners (SRC-19, SRC-18, PRJ-24)."""
    rad = degrees * (math.pi / 180)
    flat = [(F.col(f"x{a}") * scale, F.col(f"y{b}") * scale) for a in (0, 1) for b in (0, 1)]
    xs, ys = [x * F.cos(rad) - y * F.sin(rad) for x, y in flat], [x * F.sin(rad) + y * F.cos(rad) for x, y in flat]
    zs = [F.col(f"z{s}") * scale for s in (0, 1)]
    out = {}
    for k, v in (("x", xs), ("y", ys), ("z", zs)):
        out |= {f"{k}0": F.least(*v) + move[k], f"{k}1": F.greatest(*v) + move[k]}
    return out


def adjacent_volumes(surfaces: DataFrame, volumes: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(surface, volume): volumes whose box a surface's box touches and of whose planes it shares one, in which it lies, or whose region it names (SPA-10).

    Both are (id, region, x0, ..., z1). The tolerance grows with the coordinates. The join is on tiles of all axes, in levels by the boxes' sizes.
    """
    b = [f"{k}{s}" for k in g.AXES for s in (0, 1)]
    # each box's own tolerances are worked out once, before it meets others
    own = {k: F.lit(eps) * F.greatest(F.lit(1.0), F.abs(f"{k}0"), F.abs(f"{k}1")) for k in g.AXES}
    s, v = (t.select(*(F.col(c).alias(f"{p}_{c}") for c in ["id", "region", *b]), *(own[k].alias(f"{p}_tol_{k}") for k in g.AXES)) for t, p in ((surfaces, "s"), (volumes, "v")))
    wide = lambda p: [x for k in g.AXES for x in spans(f"{p}_", k, F.col(f"{p}_tol_{k}"))]
    tol = {k: F.greatest(f"s_tol_{k}", f"v_tol_{k}") for k in g.AXES}
    touch = reduce(lambda x, y: x & y, ((F.greatest(f"s_{k}0", f"v_{k}0") <= F.least(f"s_{k}1", f"v_{k}1") + tol[k]) for k in g.AXES))
    # a surface is flat along an axis of its own: there it may lie on a plane of the volume
    plane = reduce(lambda x, y: x | y, ((F.abs(F.col(f"s_{k}1") - F.col(f"s_{k}0")) <= tol[k]) & ((F.abs(F.col(f"s_{k}0") - F.col(f"v_{k}0")) <= tol[k]) | (F.abs(F.col(f"s_{k}0") - F.col(f"v_{k}1")) <= tol[k])) for k in g.AXES))
    inside = reduce(lambda x, y: x & y, ((F.col(f"s_{k}0") >= F.col(f"v_{k}0") - tol[k]) & (F.col(f"s_{k}1") <= F.col(f"v_{k}1") + tol[k]) for k in g.AXES))
    hit = touch & (plane | inside | F.coalesce(F.col("s_region") == F.col("v_region"), F.lit(False)))
    return tiled_join(s, v, wide("s"), wide("v")).where(hit).select(F.col("s_id").alias("surface"), F.col("v_id").alias("volume")).distinct()


def boundary_type(face: dict[str, Column]) -> Column:
    """A face's boundary type by its label and role: the top is ground, the bottom bottom; horizontal roles are layers, other outer faces external (PRJ-25)."""
    return (
        F.when(face["label"] == "z1", "ground_surface").when(face["label"] == "z0", "bottom").when(F.coalesce(face["role"].contains("horizontal"), F.lit(False)), "horizontal_layer")
        .when(F.coalesce(face["boundary"], F.lit(False)), "external").otherwise("unknown")
    )


def semantic_role(*columns: Column) -> Column:
    """The first of the columns that isn't blank, in lower case with _ for spaces; else `entity` (PRJ-26)."""
    named = [F.when(F.trim(c) != "", F.trim(c)) for c in columns]
    return F.regexp_replace(F.lower(F.coalesce(*named, F.lit("entity"))), " ", "_")


def is_soil_volume(role: Column, source: Column, cutter: Column, bounds: Column) -> Column:
    """Soil by role, or from a known source, with bounds and no cutter (FLT-12)."""
    return (F.coalesce(role.isin(*SOIL_ROLES), F.lit(False)) | source.isNotNull()) & ~F.coalesce(cutter, F.lit(False)) & bounds.isNotNull()


def is_cutter(role: Column, cutter: Column) -> Column:
    """Marked as a cutter, or of a structure's role (FLT-13)."""
    return F.coalesce(cutter, F.lit(False)) | F.coalesce(role.isin(*CUTTER_ROLES), F.lit(False))


def pickable(visible: Column, locked: Column) -> Column:
    """Visible and not locked (FLT-08, FLT-09)."""
    return F.coalesce(visible, F.lit(False)) & ~F.coalesce(locked, F.lit(False))


def meshing_objects(objects: DataFrame, materials: DataFrame) -> DataFrame:
    """Objects whose region has a material; all of them if none has (FLT-03)."""
    bound = objects.join(materials.select("region").distinct(), "region", "left_semi")
    some = F.broadcast(bound.agg((F.count("*") > 0).alias("some")))  # one row
    flagged = objects.join(materials.select("region", F.lit(True).alias("has")).distinct(), "region", "left").join(some)
    return flagged.where("has or not some").drop("has", "some")


def selected_regions(explicit: DataFrame, selected: DataFrame, every: DataFrame) -> DataFrame:
    """(name, rank): explicit names, then selected ones, each once in order; all regions where there are none (FLT-01, SET-11).

    Tables are (name, seq)."""
    named = explicit.select("name", F.lit(0).alias("t"), "seq").union(selected.select("name", F.lit(1), "seq"))
    none = F.broadcast(named.agg((F.count("*") == 0).alias("none")))  # one row
    rows = named.union(every.join(none).where("none").select("name", F.lit(2), "seq"))
    first = rows.groupBy("name").agg(F.min(F.struct("t", "seq")).alias("at"))
    return first.select("name", F.col("at.t").alias("table"), F.col("at.seq").alias("seq"))


def fixed_length(values: Column, length: int, default: float) -> Column:
    """An array's first `length` numbers, padded with `default`; what is no number becomes it too (FN-17)."""
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(float(default)))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: number(F.get(F.coalesce(values, F.array().cast("array<string>")), i)))
