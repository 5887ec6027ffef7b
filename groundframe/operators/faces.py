"""Faces of meshes: face sets and their owners, boundary names, closure and repair of triangulated surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g
from . import mesh

#: Dots with the first normal down to this count as consistent.
CONSISTENT = -0.2


def face_owners(triangles: DataFrame, cells: DataFrame) -> DataFrame:
    """`triangles` (tri_id, conn, ...) with owner and neighbour (cell, local face) among `cells`, null where no cell has that face (JOIN-09).

    The join is on the sorted nodes; of a face's cells the one of the smallest id is the owner.
    """
    kinds = cells.select("cell_id", "cell_type", "conn", "region")
    faces = F.lit(None).cast("array<array<bigint>>")
    for kind, local in mesh.FACES.items():
        faces = F.when(F.col("cell_type") == kind, F.array(*(F.array(*(F.get("conn", F.lit(i)) for i in f)) for f in local))).otherwise(faces)
    flat = kinds.select("cell_id", "region", F.posexplode(faces).alias("local", "face")).select(F.array_sort("face").alias("face_key"), F.struct("cell_id", "local", "region").alias("use"))
    keyed = triangles.withColumn("face_key", F.array_sort("conn"))
    wanted = keyed.select("face_key").distinct()
    uses = flat.join(wanted, "face_key", "left_semi").groupBy("face_key").agg(F.array_sort(F.collect_list("use")).alias("uses"))
    out = keyed.join(uses, "face_key", "left").drop("face_key")
    return out.withColumns({"owner": F.get("uses", F.lit(0)), "neighbour": F.get("uses", F.lit(1))}).drop("uses")


def face_sets(owned: DataFrame) -> DataFrame:
    """Per set, of `face_owners` rows with set, tri_id and pts: faces, matched, internal, area, first owner region, mean normal and the
    share of normals that agree with the first one's direction (AGG-16).

    The first normal of a set is found first and joined back, so no list of a set's normals is built.
    """
    p = F.col("pts")
    own = owned.withColumns({"normal": g.triangle_normal(p), "area": g.triangle_area(p[0], p[1], p[2])})
    first = own.groupBy("set").agg(F.min_by("normal", "tri_id").alias("first"))
    both = own.join(first, "set")
    agree = g.dot(F.col("normal"), F.col("first")) >= CONSISTENT
    mean = {f"n{k}": F.avg(F.col("normal")[k]) for k in g.AXES}
    return both.groupBy("set").agg(
        F.count("*").alias("faces"), F.count("owner").alias("matched"), F.count("neighbour").alias("internal"), F.sum("area").alias("area"),
        F.min_by("owner.region", F.when(F.col("owner").isNotNull(), F.col("tri_id"))).alias("owner_region"), *(v.alias(k) for k, v in mean.items()), F.avg(agree.cast("double")).alias("consistency"),
    )


def set_counts(owned: DataFrame) -> DataFrame:
    """Per set, of `face_owners` rows with set: faces, matched and internal, as in `face_sets`, without their geometry."""
    return owned.groupBy("set").agg(F.count("*").alias("faces"), F.count("owner").alias("matched"), F.count("neighbour").alias("internal"))


def bind_face_sets(bindings: DataFrame, sets: DataFrame) -> DataFrame:
    """(binding, kind, target, faces, status): bindings of conditions, loads and interfaces to face sets; bound only if the set has matched
    faces, and an interface only if all of them have a neighbour (JOIN-23). `sets`: `set_counts` or `face_sets`.
    """
    out = bindings.join(sets.select(F.col("set").alias("target"), "faces", "matched", "internal"), "target", "left")
    ok = (F.col("matched") > 0) & ((F.col("kind") != "interface") | (F.col("internal") == F.col("matched")))
    status = F.when(F.col("faces").isNull(), "unknown").when(ok, "bound").when(F.col("kind") == "interface", "one_sided").otherwise("unmatched")
    return out.select("binding", "kind", "target", F.coalesce("faces", F.lit(0)).alias("faces"), status.alias("status"))


def boundary_name(x: Column, y: Column, z: Column, tolerance: float = 1e-9) -> Column:
    """The nearest of a box's planes (columns x0 to z1), xmin to zmax, ties in that order; `external` beyond the tolerance (FN-08)."""
    far = [(F.abs(c - F.col(f"{k}{s}")), f"{k}{n}") for k, c in (("x", x), ("y", y), ("z", z)) for s, n in ((0, "min"), (1, "max"))]
    nearest = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (d, n) in enumerate(far))))
    span = F.greatest(*(F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"), F.lit(1.0))
    return F.when(nearest["d"] <= F.greatest(F.lit(tolerance), span * 1e-8), nearest["n"]).otherwise("external")


def weld(triangles: DataFrame, digits: int = 10) -> DataFrame:
    """`triangles` (region, tri_id, pts) with `conn`: corner keys by rounded coordinates, so that equal corners are one (SET-03, SET-06)."""
    key = lambda q: F.struct(*((F.round(q[k], digits) + F.lit(0.0)).alias(k) for k in g.AXES))  # noqa: E731  (0.0 for -0.0)
    return triangles.withColumn("conn", F.transform("pts", key))


def surface_repair(triangles: DataFrame, *, digits: int = 10, degenerate: float = 1e-14) -> DataFrame:
    """Per region of a triangle soup (region, tri_id, pts): what a repair would meet (VAL-05, VAL-08, AGG-04, AGG-06).

    Triangles, distinct corners, corners that repeat one, triangles of `degenerate` area or less, edges used once and more
    than twice, whether the surface is closed (every edge used twice, degenerate triangles left out), and whether it is
    a candidate for a conformal mesh (closed, with 4 or 8 corners).
    """
    p = F.col("pts")
    own = weld(triangles, digits).withColumn("area", g.triangle_area(p[0], p[1], p[2]))
    c = F.col("conn")
    sound = own.where(F.col("area") > degenerate)
    edges = sound.select("region", F.explode(F.array(*(F.array_sort(F.array(c[a], c[b])) for a, b in ((0, 1), (1, 2), (2, 0))))).alias("e"))
    edges = edges.groupBy("region", "e").agg(F.count("*").alias("uses")).groupBy("region").agg(F.count_if(F.col("uses") == 1).alias("open_edges"), F.count_if(F.col("uses") > 2).alias("busy_edges"))
    corners = own.select("region", F.explode("conn").alias("n")).distinct().groupBy("region").agg(F.count("*").alias("corners"))
    out = own.groupBy("region").agg(F.count("*").alias("triangles"), F.count_if(F.col("area") <= degenerate).alias("degenerate"), F.sum("area").alias("area"))
    out = out.join(corners, "region").join(edges, "region", "left").fillna(0, ["open_edges", "busy_edges"])
    closed = (F.col("open_edges") == 0) & (F.col("busy_edges") == 0) & (F.col("triangles") > F.col("degenerate"))
    return out.withColumns({"repeated": F.col("triangles") * 3 - F.col("corners"), "closed": closed, "conformal": closed & F.col("corners").isin(4, 8)})


def oriented(triangles: DataFrame) -> DataFrame:
    """Per region: the signed volume of its surface, and whether all triangles should be turned round: closed surfaces of negative volume (SET-07).

    Every edge of a well-oriented surface is used once in each direction; `turned` counts those used twice in one.
    """
    p = F.col("pts")
    own = weld(triangles)
    volume = own.groupBy("region").agg((F.sum(g.dot(p[0], g.cross(p[1], p[2]))) / 6).alias("volume"))  # divided last: whole numbers add up exactly
    c = F.col("conn")
    edges = own.select("region", F.explode(F.array(*(F.struct(F.array_sort(F.array(c[a], c[b])).alias("e"), (c[a] < c[b]).alias("up")) for a, b in ((0, 1), (1, 2), (2, 0))))).alias("x"))
    edges = edges.groupBy("region", "x.e").agg(F.count("*").alias("n"), F.count_if("x.up").alias("up"))
    edges = edges.groupBy("region").agg(F.bool_and(F.col("n") == 2).alias("closed"), F.count_if((F.col("n") == 2) & (F.col("up") != 1)).alias("turned"))
    return volume.join(edges, "region").withColumn("flip", F.col("closed") & (F.col("volume") < 0))


def closed_to_tets(triangles: DataFrame) -> DataFrame:
    """Per closed region with 4 or 8 corners: tetrahedra it is cut into, one or five, and their volume by the surface (GEN-21)."""
    rep = surface_repair(triangles).where("conformal").select("region", "corners")
    return oriented(triangles).join(rep, "region").select("region", F.when(F.col("corners") == 4, 1).otherwise(5).alias("tets"), F.abs("volume").alias("volume"))
