"""Layered volumes: soil layers cut out of boxes, meshes swept between surface grids, layers of imported geology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as g

#: Parts of a field's name that tell of geology, and names that never do (fixed values).
GEOLOGY_TOKENS = (
    "soil", "stratum", "strata", "layer", "geology", "geo", "lithology", "formation", "material", "mat", "rock", "phase", "physical", "gmsh", "region", "domain", "zone", "group", "unit", "facies",
)
PLAIN_NAMES = ("connectivity", "offsets", "types")


def soil_layers(layers: DataFrame, bounds: DataFrame, *, default: str = "soil_layer") -> DataFrame:
    """(model, layer, z_min, z_max, seq, below): layers clamped to their model's extent, empty ones left out, from the lowest up (SRT-02).

    `layers`: (model, layer, a, b), the two levels in any order; `bounds`: (model, z0, z1). A model without a layer left
    has one, `default`, over its extent (of height one where that is flat). `below` is the layer next below, which the
    layer shares an interface with, even if a gap lies between.
    """
    clamp = lambda c: F.greatest(F.least(F.col(c), F.col("z1")), F.col("z0"))
    kept = layers.join(bounds, "model").select("model", "layer", F.least(clamp("a"), clamp("b")).alias("z_min"), F.greatest(clamp("a"), clamp("b")).alias("z_max")).where("z_max > z_min")
    rest = bounds.join(kept.select("model").distinct(), "model", "left_anti")
    rest = rest.select("model", F.lit(default).alias("layer"), F.col("z0").alias("z_min"), F.when(F.col("z1") > F.col("z0"), F.col("z1")).otherwise(F.col("z0") + 1).alias("z_max"))
    w = Window.partitionBy("model").orderBy("z_min", "layer")
    return kept.unionByName(rest).withColumns({"seq": F.row_number().over(w), "below": F.lag("layer").over(w)})


def layer_cut_report(layers: DataFrame, nx: int, ny: int) -> DataFrame:
    """Per model, of a lattice of nx * ny columns cut at its layers: layers, cells, nodes (levels that layers share count once), interfaces (GEN-08)."""
    levels = layers.select("model", F.explode(F.array("z_min", "z_max")).alias("z")).groupBy("model").agg((F.count_distinct(F.rint(F.col("z") * 1e12)) * ((nx + 1) * (ny + 1))).alias("nodes"))
    own = layers.groupBy("model").agg(F.count("*").alias("layers"), (F.count("*") * (nx * ny)).alias("cells"), F.count("below").alias("interfaces"), F.min("z_min").alias("low"), F.max("z_max").alias("high"))
    return own.join(levels, "model")


def layer_cells(layers: DataFrame, bounds: DataFrame, nx: int, ny: int) -> DataFrame:
    """Hexahedra of each layer's nx * ny columns with their corner points: (model, layer, i, j, pts); `bounds`: (model, x0, x1, y0, y1) (GEN-08)."""
    both = layers.join(bounds.select("model", "x0", "x1", "y0", "y1"), "model")
    span = lambda k: F.when(F.col(f"{k}1") > F.col(f"{k}0"), F.col(f"{k}1") - F.col(f"{k}0")).otherwise(1.0)
    both = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    x = lambda d: F.col("x0") + span("x") * (F.col("i") + d) / nx
    y = lambda d: F.col("y0") + span("y") * (F.col("j") + d) / ny
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    pts = F.array(*(g.point(x(a), y(b), F.col(z)) for z in ("z_min", "z_max") for a, b in ring))
    return both.select("model", "layer", "i", "j", pts.alias("pts"))


def layered_mesh(grid: DataFrame, nx: int, ny: int, *, least: float = 1e-12) -> DataFrame:
    """Hexahedra swept between the top and bottom surfaces of each layer: (layer, i, j, conn, volume) (GEN-05, GEN-09).

    `grid`: (layer long, i, j, x, y, top, bottom) at nx * ny points a layer. Nodes aren't shared between layers: a layer
    has its top points, then its bottom ones. The bottom face comes first in `conn`. Cells whose bounding box has `least`
    volume or less are left out, as are those with a point missing. Every point goes to the four cells around it, in one
    shuffle.
    """
    cells = F.array(*(F.struct((F.col("i") - a).alias("ci"), (F.col("j") - b).alias("cj")) for a in (0, 1) for b in (0, 1)))
    flat = grid.select("layer", "x", "y", "top", "bottom", F.explode(cells).alias("c")).select("layer", "c.ci", "c.cj", "x", "y", "top", "bottom")
    flat = flat.where(f"ci >= 0 and cj >= 0 and ci < {nx - 1} and cj < {ny - 1} and top is not null and bottom is not null")
    box = flat.groupBy("layer", F.col("ci").alias("i"), F.col("cj").alias("j")).agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"),
        (F.max(F.greatest("top", "bottom")) - F.min(F.least("top", "bottom"))).alias("dz"),
    )
    node = lambda side, a, b: ((F.col("layer") * 2 + side) * ny + F.col("j") + b) * nx + F.col("i") + a
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    conn = F.array(*(node(1, a, b) for a, b in ring), *(node(0, a, b) for a, b in ring))
    volume = F.col("dx") * F.col("dy") * F.col("dz")
    return box.where((F.col("n") == 4) & (volume > least)).select("layer", "i", "j", conn.alias("conn"), volume.alias("volume"))


def grid_triangles(grid: DataFrame, nx: int, ny: int) -> DataFrame:
    """Two triangles for every quad of a surface's grid (surface, i, j, x, y, z): (surface, i, j, part, pts) (GEN-26)."""
    corners = F.array(*(F.struct((F.col("i") - a).alias("ci"), (F.col("j") - b).alias("cj"), F.lit(2 * b + a).alias("at")) for a in (0, 1) for b in (0, 1)))
    flat = grid.select("surface", g.point(F.col("x"), F.col("y"), F.col("z")).alias("p"), F.explode(corners).alias("c")).select("surface", "p", "c.*")
    quads = flat.where(f"ci >= 0 and cj >= 0 and ci < {nx - 1} and cj < {ny - 1}").groupBy("surface", F.col("ci").alias("i"), F.col("cj").alias("j"))
    quads = quads.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("q")).where(F.size("q") == 4)
    q = F.col("q")
    return quads.select("surface", "i", "j", F.posexplode(F.array(F.array(q[0], q[1], q[3]), F.array(q[0], q[3], q[2]))).alias("part", "pts"))


def surface_summary(samples: DataFrame) -> DataFrame:
    """Per layer, of samples (layer, hole, z): count, holes, mean, least and greatest level, and whether they are too few for a surface (AGG-25)."""
    return samples.groupBy("layer").agg(F.count("*").alias("samples"), F.count_distinct("hole").alias("holes"), F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"), (F.count("*") < 2).alias("sparse"))


def looks_like_geology(name: Column) -> Column:
    """Whether a field's name tells of geology (FLT-14)."""
    key = F.translate(F.lower(F.coalesce(name, F.lit(""))), "-: ", "___")
    return key.rlike("|".join(GEOLOGY_TOKENS)) & ~key.startswith("vtk") & ~key.isin(*PLAIN_NAMES)


def cell_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, label): the label that most of a cell's nodes have, the smallest on ties; nodes without one don't count (FN-05).

    `labels`: (node_id, label). Counts are combined before the shuffle that finds a cell's most frequent one.
    """
    flat = cells.select("cell_id", F.explode("conn").alias("node_id")).join(labels, "node_id").groupBy("cell_id", "label").agg(F.count("*").alias("n"))
    return flat.groupBy("cell_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label").cast("string"))).alias("label"))


def imported_layers(cells: DataFrame, edited: DataFrame) -> DataFrame:
    """Volumes and materials of imported geology: one row a label of `cells` (cell_id, label) (JOIN-25).

    A material that a user edited (`edited`: label, material, stiffness) is kept; others get the label's own name and a
    default stiffness. Cells without a label are one layer, `unassigned`.
    """
    own = cells.groupBy(F.coalesce("label", F.lit("unassigned")).alias("label")).agg(F.count("*").alias("cells"))
    kept = edited.groupBy("label").agg(F.min_by(F.struct("material", "stiffness"), "material").alias("e"))
    out = own.join(kept, "label", "left")
    return out.select("label", "cells", F.coalesce("e.material", F.concat(F.lit("mat_"), "label")).alias("material"), F.coalesce("e.stiffness", F.lit(30_000.0)).alias("stiffness"), F.col("e").isNotNull().alias("edited"))
