"""Shape of tetrahedra, quality flags, gates and local refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g
from . import mesh

#: Edges of a tetrahedron, and its faces with their pairs, as the angles are taken.
EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
FACES = ((1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1))
#: A hexahedron as six tetrahedra around its diagonal (GEN-22, GEN-23).
HEX_TETS6 = [(0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6)]


def edge_lengths(p: Column) -> list[Column]:
    return [g.norm(g.sub(p[b], p[a])) for a, b in EDGES]


def dihedral_angles(normals: Column) -> list[Column]:
    """The six angles between faces, in degrees: 180 less the angle between their unit normals (zero for flat faces) (PRJ-13)."""
    return [180 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(normals[i], normals[j]))))) for i, j in EDGES]


def tet_quality(cells: DataFrame, nodes: DataFrame | None, *, sliver: float = 20.0, angle: float = 5.0) -> DataFrame:
    """Tetrahedra with volume (signed), aspect, angles and flags (AGG-09, SET-10, PRJ-02, PRJ-12).

    The aspect is the greater of longest over shortest edge and an eighth of the longest edge's cube over the volume. A
    cell is inverted at a volume of zero or less, tiny at or below a millionth of the smallest volume (1e-14 at
    least), a sliver from `sliver` on, poor with an angle up to `angle` or from 175 degrees on; bad with any of these.
    Without `nodes`, the cells have their points (`pts`).
    """
    own = cells.where("cell_type = 'tet4'")
    own = own if nodes is None else mesh.with_points(own, nodes)
    p = F.col("pts")
    crosses = F.array(*(g.cross(g.sub(p[b], p[a]), g.sub(p[c], p[a])) for a, b, c in FACES))
    # each step reads the one before more than once, so they are columns of their own
    own = own.withColumns({"volume": g.signed_tet_volume(p), "edges": F.array(*edge_lengths(p)), "normals": crosses}).drop("pts")
    own = own.withColumn("normals", F.transform("normals", lambda n: F.struct(n.alias("n"), g.norm(n).alias("l"))))
    own = own.withColumn("normals", F.transform("normals", lambda x: g.point(*(F.when(x["l"] > 1e-30, x["n"][k] / x["l"]).otherwise(0.0) for k in g.AXES))))
    own = own.withColumn("angles", F.array(*dihedral_angles(F.col("normals")))).drop("normals")
    longest = F.array_max("edges")
    aspect = F.greatest(longest / F.greatest(F.array_min("edges"), F.lit(1e-30)), longest**3 / F.greatest(F.abs("volume"), F.lit(1e-30)) / 8)
    least = F.broadcast(own.agg(F.greatest(F.min(F.abs("volume")) * 1e-6, F.lit(1e-14)).alias("tiny_at")))  # one row
    out = own.withColumns({"aspect": aspect, "low_angle": F.array_min("angles"), "high_angle": F.array_max("angles")}).drop("edges", "angles").join(least)
    flags = {
        "sliver": F.col("aspect") >= sliver, "inverted": F.col("volume") <= 0, "tiny": F.abs("volume") <= F.col("tiny_at"),
        "poor": (F.col("low_angle") <= angle) | (F.col("high_angle") >= 175),
    }
    return out.withColumns(flags).withColumn("bad", reduce(lambda a, b: a | b, map(F.col, flags))).drop("tiny_at")


def quality_summary(quality: DataFrame, *by: str) -> DataFrame:
    """Cells, flags and the spread of volumes and aspects, by the given columns (AGG-08, AGG-09, SET-10)."""
    spread = [f(c).alias(f"{n}_{c}") for c, v in (("volume", F.abs("volume")), ("aspect", F.col("aspect"))) for n, f in (("least", F.min), ("greatest", F.max), ("mean", F.avg)) for c in [c]]
    own = quality.withColumn("volume", F.abs("volume"))
    return own.groupBy(*by).agg(F.count("*").alias("cells"), *(F.count_if(c).alias(c) for c in ("sliver", "inverted", "tiny", "poor", "bad")), *spread)


def quality_gate(measures: DataFrame, *, least: float, most_aspect: float) -> DataFrame:
    """One row: least measure, greatest aspect, bad cells, and whether the mesh passes; an empty mesh doesn't (AGG-08)."""
    bad = (F.col("measure") <= least) | F.coalesce(F.col("aspect") > most_aspect, F.lit(True))
    out = measures.agg(F.count("*").alias("cells"), F.min("measure").alias("least"), F.max("aspect").alias("aspect"), F.count_if(bad).alias("bad"))
    return out.withColumn("passed", (F.col("cells") > 0) & (F.col("bad") == 0))


def refined(cells: DataFrame, bad: DataFrame, centre: Column) -> DataFrame:
    """`cells` with bad ones cut up: a tetrahedron into four around a node of its own (`centre`), a hexahedron into five tetrahedra; tags go to
    the children, ids become 8 * cell_id + part (GEN-11). `bad`: (cell_id, measure, least); cells that measure `least` or less are dropped.
    """
    own = cells.join(bad.select("cell_id", (F.col("measure") > F.col("least")).alias("keep")), "cell_id", "left").where("keep is null or keep")
    conn, split = F.col("conn"), F.col("keep").isNotNull()
    around = F.array(*(F.array(*(conn[i] for i in f), centre) for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))))
    five = F.array(*(F.array(*(conn[i] for i in t)) for t in mesh.HEX_TETS))
    parts = F.when(split & (F.col("cell_type") == "tet4"), around).when(split & (F.col("cell_type") == "hex8"), five).otherwise(F.array(conn))
    out = own.select("*", F.posexplode(parts).alias("part", "child"))
    return out.withColumns({"cell_id": F.col("cell_id") * 8 + F.col("part"), "cell_type": F.when(split, "tet4").otherwise(F.col("cell_type")), "conn": F.col("child")}).drop("part", "child", "keep")


def hex_to_six(cells: DataFrame) -> DataFrame:
    """Cells as tetrahedra: a tetrahedron stays, a hexahedron becomes six; ids become 6 * cell_id + part (GEN-22, GEN-23)."""
    local = lambda tets: F.array(*(F.array(*map(F.lit, t)) for t in tets))
    parts = F.when(F.col("cell_type") == "tet4", local([(0, 1, 2, 3)])).when(F.col("cell_type") == "hex8", local(HEX_TETS6))
    return mesh.parts_of(cells, parts, 6)
