"""Mesh tables: cells(cell_id, cell_type, conn array<bigint>, region, ...) and nodes(node_id, x, y, z)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as g

#: Faces of each cell type by local node number, in the order that VTK documents.
FACES = {
    "tet4": [(0, 1, 3), (1, 2, 3), (2, 0, 3), (0, 2, 1)],
    "hex8": [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
    "wedge6": [(0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)],
    "pyramid5": [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
    "tri3": [(0, 1, 2)],
    "quad4": [(0, 1, 2, 3)],
}
#: A hexahedron as five tetrahedra.
HEX_TETS = [(0, 1, 3, 4), (1, 2, 3, 6), (1, 3, 4, 6), (1, 4, 5, 6), (3, 4, 6, 7)]
#: Rows of points whose pairs of regions one task makes, about.
POINTS = 100_000
#: Other spellings of cell types (FN-06).
TYPE_NAMES = {"tetra": "tet4", "tetra4": "tet4", "hexahedron": "hex8", "hexa": "hex8", "voxel": "hex8", "triangle": "tri3", "quad": "quad4", "wedge": "wedge6", "pyramid": "pyramid5"}


def _local(conn: Column, faces: list[tuple[int, ...]]) -> Column:
    return F.array(*(F.array(*(F.get(conn, F.lit(i)) for i in f)) for f in faces))


def cell_type_name(kind: Column) -> Column:
    """The one spelling of a cell type (FN-06)."""
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    return F.coalesce(names[F.lower(F.trim(kind))], F.lower(F.trim(kind)))


def cell_faces(cells: DataFrame) -> DataFrame:
    """One row per face of every cell: `face` (nodes in order) and `face_key` (sorted) (GEN-01 to GEN-03)."""
    faces = F.lit(None).cast("array<array<bigint>>")
    for kind, local in FACES.items():
        faces = F.when(F.col("cell_type") == kind, _local(F.col("conn"), local)).otherwise(faces)
    return cells.withColumn("face", F.explode(faces)).withColumn("face_key", F.array_sort("face"))


def face_uses(cells: DataFrame) -> DataFrame:
    """One row per distinct face: uses, first and last region and cell, and kind (AGG-02).

    One use is a boundary face; two an internal one, an interface if the regions differ; more is non-manifold. The
    counts are combined before the one shuffle, on the face's nodes.
    """
    by_key = cell_faces(cells).groupBy("face_key").agg(
        F.count("*").alias("uses"), F.min("region").alias("region_a"), F.max("region").alias("region_b"), F.min("cell_id").alias("cell_a"), F.max("cell_id").alias("cell_b")
    )
    kind = F.when(F.col("uses") == 1, "boundary").when(F.col("uses") > 2, "nonmanifold").when(F.col("region_a") == F.col("region_b"), "internal").otherwise("interface")
    return by_key.withColumn("kind", kind)


def region_report(cells: DataFrame) -> DataFrame:
    """Per region: cells, distinct nodes, boundary and interface faces (AGG-01). Cells are counted at their first nodes, along with the nodes."""
    at = cells.select("region", F.posexplode("conn").alias("at", "n")).groupBy("region", "n").agg(F.count_if(F.col("at") == 0).alias("firsts"))
    own = at.groupBy("region").agg(F.sum("firsts").alias("cells"), F.count("*").alias("nodes"))
    faces = face_uses(cells).where(F.col("kind").isin("boundary", "interface"))
    sides = faces.select(F.col("kind"), F.explode(F.array_distinct(F.array("region_a", "region_b"))).alias("region"))
    count = sides.groupBy("region").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_faces") for k in ("boundary", "interface")))
    return own.join(count, "region", "left").fillna(0, ["boundary_faces", "interface_faces"])


def region_boundary_adjacency(cells: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of regions that share faces, at least max(1, `least`) (JOIN-02)."""
    shared = face_uses(cells).where("kind = 'interface'")
    return shared.groupBy("region_a", "region_b").agg(F.count("*").alias("faces")).where(F.col("faces") >= max(1, least))


def nonmanifold_report(cells: DataFrame) -> DataFrame:
    """Histogram of face uses, and cells that repeat another's nodes as uses = -1 (AGG-03)."""
    uses = face_uses(cells).groupBy("uses").agg(F.count("*").alias("n"))
    copies = cells.groupBy(F.array_sort("conn").alias("key")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return uses.select(F.col("uses").cast("long"), "n").union(copies.select(F.lit(-1).cast("long"), "n"))


def edge_uses(triangles: DataFrame) -> DataFrame:
    """Undirected edges of triangles and how often they are used (AGG-05)."""
    c = F.col("conn")
    pairs = F.array(*(F.array(F.least(c[a], c[b]), F.greatest(c[a], c[b])) for a, b in ((0, 1), (1, 2), (2, 0))))
    return triangles.select(F.explode(pairs).alias("e")).groupBy(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")).agg(F.count("*").alias("uses"))


def region_adjacency(points: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of regions (a < b) that share at least `least` points; `points` is (region, point) (JOIN-01, SET-14).

    Points with equal sets of regions are counted together, so pairs are made once for each set, not for each point; a large
    set is taken apart by its members first, whose pairs different tasks can make. Sets are dealt over tasks by the number of `points`, not by
    their bytes, since a short set makes many pairs.
    """
    tasks = max(1, -(-points.count() // POINTS))
    sets = points.select("region", "point").distinct().groupBy("point").agg(F.sort_array(F.collect_list("region")).alias("s")).where(F.size("s") > 1)
    sets = sets.groupBy("s").agg(F.count("*").alias("n")).repartition(tasks, "s")
    ones = sets.select("n", "s", F.posexplode("s").alias("i", "region_a"))
    both = ones.select("n", "region_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("region_b"))
    return both.groupBy("region_a", "region_b").agg(F.sum("n").alias("shared")).where(F.col("shared") >= least)


def merge_nodes(nodes: DataFrame, tolerance: float) -> DataFrame:
    """(node_id, new_id, x, y, z): nodes of equal round(v / tolerance), halves to even, become the earliest (SET-03).

    New ids are the earliest old ones: numbering them through would need one sorted pass over all nodes; see `compact_ids`.
    """
    key = [F.rint(F.col(k) / tolerance).cast("long").alias(f"k{k}") for k in g.AXES]
    keyed = nodes.select("*", *key)
    first = keyed.groupBy("kx", "ky", "kz").agg(F.min_by(F.struct("node_id", "x", "y", "z"), "node_id").alias("f"))
    return keyed.select("node_id", "kx", "ky", "kz").join(first, ["kx", "ky", "kz"]).select("node_id", F.col("f.node_id").alias("new_id"), "f.x", "f.y", "f.z")


def _gathered(cells: DataFrame, of: DataFrame) -> DataFrame:
    """`cells` without `conn`, with `at_nodes`: for each of their nodes in order (at, conn, of), where `of` is the node's struct `of` or null.

    A cell's other columns travel with its first node, in the one list, so its nodes and they come together in one grouping,
    and readers of different columns share its shuffles.
    """
    rest = [c for c in cells.columns if c not in ("cell_id", "pts")]
    flat = cells.select("cell_id", F.struct(*rest).alias("own"), F.posexplode("conn").alias("at", "node_id"))
    flat = flat.withColumn("own", F.when(F.col("at") == 0, F.col("own"))).join(of, "node_id", "left")
    c = flat.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("at", "of", "own"))).alias("at_nodes"))
    return c.select("cell_id", F.col("at_nodes")[0]["own"].alias("own"), "at_nodes").select("cell_id", "own.*", "at_nodes")


def _placed(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """`cells` with `pts`, null for a node without a point."""
    at = nodes.select("node_id", g.point(F.col("x"), F.col("y"), F.col("z")).alias("of"))
    return _gathered(cells, at).withColumn("pts", F.transform("at_nodes", lambda x: x["of"])).drop("at_nodes")


def with_points(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """`cells` with `pts`, their nodes' points in order; nodes without a point are left out."""
    return _placed(cells, nodes).withColumn("pts", F.array_compact("pts")).where(F.size("pts") > 0)


def split_with_points(cells: DataFrame, nodes: DataFrame, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parts that `split` makes of `cells`, with `pts`: `with_points(split(cells), nodes)`, but points come to cells, once, not to each of their parts."""
    return split(_placed(cells, nodes)).withColumn("pts", F.array_compact("pts")).where(F.size("pts") > 0)


def parts_of(cells: DataFrame, parts: Column, times: int) -> DataFrame:
    """Tetrahedra out of `parts`, arrays of local node numbers: `cell_id` becomes `times` * cell_id + part; points, if there are any, go with their nodes."""
    both = [c for c in ("conn", "pts") if c in cells.columns]
    picked = cells.select("*", F.posexplode(parts).alias("part", "tet"))
    here = lambda c: F.transform("tet", lambda i: F.get(F.col(c), i))
    return picked.withColumns({"cell_id": F.col("cell_id") * times + F.col("part"), "cell_type": F.lit("tet4"), **{c: here(c) for c in both}}).drop("part", "tet")


def optimise(cells: DataFrame, nodes: DataFrame, tolerance: float, least: float = 1e-12, drop_copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged nodes, without cells that repeat a node or measure `least` or less; `drop_copies` also drops later cells of
    equal nodes. Returns (cells, used nodes) (SET-04, SET-05). Cells meet their merged nodes once, for ids and points together."""
    merged = merge_nodes(nodes, tolerance)
    of = merged.select("node_id", F.struct("new_id", g.point(F.col("x"), F.col("y"), F.col("z")).alias("p")).alias("of"))
    own = merged.select(F.col("new_id").alias("node_id"), "x", "y", "z").distinct()
    found = _gathered(cells, of).withColumn("at_nodes", F.filter("at_nodes", lambda x: x["of"].isNotNull()))
    cells = found.withColumns({"conn": F.transform("at_nodes", lambda x: x["of"]["new_id"]), "pts": F.transform("at_nodes", lambda x: x["of"]["p"])}).drop("at_nodes")
    cells = cells.where((F.size("conn") > 0) & (F.size("conn") == F.size(F.array_distinct("conn"))))
    cells = cells.where(g.cell_measure(F.col("cell_type"), F.col("pts")) > least).drop("pts")
    if drop_copies:
        w = Window.partitionBy(F.array_sort("conn")).orderBy("cell_id")
        cells = cells.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")
    used = cells.select(F.explode("conn").alias("node_id")).distinct()
    return cells, own.join(used, "node_id", "left_semi")


def cell_quality(cells: DataFrame, nodes: DataFrame, most_aspect: float = 20.0, least: float = 1e-12) -> DataFrame:
    """Measure, aspect, quality min(1, 1 / max(1, aspect)) and `bad` of every cell (AGG-10, FLT-10)."""
    pts = F.col("pts")
    out = with_points(cells, nodes).withColumns({"measure": g.cell_measure(F.col("cell_type"), pts), "aspect": g.aspect_ratio(pts)})
    bad = (F.col("measure") <= least) | F.coalesce(F.col("aspect") > most_aspect, F.lit(True))
    return out.withColumns({"quality": F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), F.coalesce("aspect", F.lit(float("inf"))))), "bad": bad}).drop("pts")


def region_quality(quality: DataFrame) -> DataFrame:
    """Per region: cells, least measure, greatest aspect, bad cells (AGG-07; hexahedra have their box's volume here)."""
    return quality.groupBy("region").agg(F.count("*").alias("cells"), F.min("measure").alias("least"), F.max("aspect").alias("aspect"), F.count_if("bad").alias("bad"))


def hex_to_tets(cells: DataFrame) -> DataFrame:
    """Hexahedra as five tetrahedra each: `cell_id` becomes 5 * cell_id + part (GEN-07, GEN-33)."""
    return parts_of(cells.where("cell_type = 'hex8'"), F.array(*(F.array(*map(F.lit, t)) for t in HEX_TETS)), 5)


def coarsen_voxels(vox: DataFrame, fx: int, fy: int, fz: int) -> DataFrame:
    """Blocks of fx * fy * fz voxels with the label most of them have, the smallest on ties."""
    at = [F.floor(F.col(k) / f).cast("long").alias(k) for k, f in (("i", fx), ("j", fy), ("k", fz))]
    counts = vox.groupBy(*at, "label").agg(F.count("*").alias("n"))
    best = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    return counts.groupBy("i", "j", "k").agg(best.alias("label"), F.sum("n").alias("voxels"))


def layer_tags(cells: DataFrame, value: Column, bins: int) -> DataFrame:
    """`cells` with `layer`: equal-width bins of `value`, numbered from the top (FN-07)."""
    bounds = cells.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    out = cells.join(F.broadcast(bounds))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("hi") - value) / width))).otherwise(F.lit(0))
    return out.withColumn("layer", F.concat(F.lit("layer_"), F.lpad(at.cast("int").cast("string"), 2, "0"))).drop("lo", "hi")


def hex_lattice(vox: DataFrame, nx: int, ny: int) -> DataFrame:
    """Voxels (i, j, k, label) as cells of a lattice of nx * ny columns with shared nodes (GEN-06, GEN-30)."""
    node = lambda di, dj, dk: (((F.col("k") + dk) * (ny + 1) + F.col("j") + dj) * (nx + 1) + F.col("i") + di)
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    cell = (F.col("k") * ny + F.col("j")) * nx + F.col("i")
    return vox.select(cell.alias("cell_id"), F.lit("hex8").alias("cell_type"), F.array(*(node(*c) for c in corners)).alias("conn"), F.col("label").alias("region"))


def lattice_nodes(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """The nodes that `hex_lattice` cells use, at unit spacing."""
    n = F.col("node_id")
    at = {"x": n % (nx + 1), "y": F.floor(n / (nx + 1)) % (ny + 1), "z": F.floor(n / ((nx + 1) * (ny + 1)))}
    return cells.select(F.explode("conn").alias("node_id")).distinct().withColumns({k: v.cast("double") for k, v in at.items()})
