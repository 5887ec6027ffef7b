"""Volumes out of closed triangulated surfaces: lattice cells whose centres lie inside (GEN-20, GEN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import AXES
from .tiles import sorted_join

#: An extent of this or less is none.
FLAT = 1e-9
#: Cells along the longest side where no size is given.
ALONG = 24


def lattices(triangles: DataFrame, *, size: float | None = None, padding: float = 0.0, most: int | None = None) -> DataFrame:
    """(region, size, x0, y0, z0, nx, ny, nz, status) for the regions of triangles (region, tri_id, pts).

    A region's lattice begins at its lower bounds less `padding`; cells have edges of `size`, else the longest side over 24.
    `status` is `flat` for a region without extent along an axis, `too_large` for one of more than `most` cells, else `ok`.
    """
    p = F.explode("pts").alias("p")
    own = triangles.select("region", p).groupBy("region").agg(*(f(F.col("p")[k]).alias(f"{k}{s}") for k in AXES for s, f in ((0, F.min), (1, F.max))))
    thin = F.least(*(F.col(f"{k}1") - F.col(f"{k}0") for k in AXES)) <= FLAT
    edge = F.greatest(*(F.col(f"{k}1") - F.col(f"{k}0") + 2 * padding for k in AXES)) / ALONG if size is None else F.lit(max(float(size), 1e-6))
    own = own.withColumns({"thin": thin, "size": edge})
    own = own.withColumns({f"n{k}": F.greatest(F.lit(1), F.ceil((F.col(f"{k}1") - F.col(f"{k}0") + 2 * padding) / F.col("size"))).cast("long") for k in AXES})
    cells = F.col("nx").cast("double") * F.col("ny") * F.col("nz")
    status = F.when(F.col("thin"), "flat").when(F.lit(most is not None) & (cells > (most or 0)), "too_large").otherwise("ok")
    return own.select("region", "size", *((F.col(f"{k}0") - padding).alias(f"{k}0") for k in AXES), *(f"n{k}" for k in AXES), status.alias("status"))


def _centre(axis: str, at: str) -> Column:
    return F.col(f"{axis}0") + (F.col(at) + 0.5) * F.col("size")


def _reach(axis: str, low: Column, high: Column) -> Column:
    """Lattice places whose centres may lie between two coordinates, one more on both sides; null if there are none."""
    place = lambda v: F.floor((v - F.col(f"{axis}0")) / F.col("size") - 0.5).cast("long")
    first, last = F.greatest(F.lit(0), place(low)), F.least(F.col(f"n{axis}") - 1, place(high) + 1)
    return F.when(first <= last, F.sequence(first, last))


def crossings(triangles: DataFrame, own: DataFrame) -> DataFrame:
    """(region, i, j, z, tri_id): where the vertical lines through the lattice's columns cross the triangles.

    A line y of centres cuts a triangle in two of its edges or none, and the columns between the two points cross it. An edge's lower
    end belongs to it, the upper one doesn't; of the two points the right one belongs to the triangle. So columns
    that meet an edge or a corner cross exactly one of the triangles round it, and parity holds there. Points on an edge are
    computed from its lower end, so triangles that share it agree to the last digit. Work and rows follow the
    number of crossings: a triangle is spread first over its lines, and these, dealt anew, over their columns.
    """
    t = triangles.join(sorted_join(own.where("status = 'ok'")), "region")
    ends = lambda a, b: F.array_sort(F.array(*(F.struct(F.col("pts")[i]["y"].alias("y"), F.col("pts")[i]["x"].alias("x"), F.col("pts")[i]["z"].alias("z")) for i in (a, b))))
    t = t.withColumn("edges", F.array(*(ends(a, b) for a, b in ((0, 1), (1, 2), (2, 0)))))
    ys = F.transform("pts", lambda q: q["y"])
    t = t.withColumn("j", F.explode(_reach("y", F.array_min(ys), F.array_max(ys)))).withColumn("yc", _centre("y", "j"))

    def met(e: Column) -> Column:
        a, b = e[0], e[1]
        share = (F.col("yc") - a["y"]) / (b["y"] - a["y"])
        return F.struct((a["x"] + share * (b["x"] - a["x"])).alias("x"), (a["z"] + share * (b["z"] - a["z"])).alias("z"))

    cut = F.filter("edges", lambda e: (e[0]["y"] <= F.col("yc")) & (F.col("yc") < e[1]["y"]))
    lines = t.withColumn("cut", F.array_sort(F.transform(cut, met))).where(F.size("cut") == 2)
    lines = lines.select("region", "tri_id", "j", "size", "x0", "nx", F.col("cut")[0].alias("a"), F.col("cut")[1].alias("b")).repartition("region", "j", "tri_id")
    at = lines.withColumn("i", F.explode(_reach("x", F.col("a.x"), F.col("b.x")))).withColumn("xc", _centre("x", "i"))
    at = at.where((F.col("xc") > F.col("a.x")) & (F.col("xc") <= F.col("b.x")))
    share = (F.col("xc") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    return at.select("region", "i", "j", (F.col("a.z") + share * (F.col("b.z") - F.col("a.z"))).alias("z"), "tri_id")


def inside(triangles: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voxels (region, i, j, k) of lattices `own` whose centres lie inside closed surfaces, and (region, open) columns that cross a surface an odd number of times.

    A centre is inside if an odd number of triangles is below it. Crossings of a column are ordered, and each odd one fills the cells
    up to the next; so one window orders what a column meets, however high the lattice. Where a surface has holes, a column's last
    crossing has no partner and fills nothing; such columns are counted. Orientation doesn't matter, and a
    surface within another is a cavity.
    """
    pairs = _pairs(triangles, own)
    odd = pairs.where("next is null").groupBy("region").agg(F.count("*").alias("open"))
    lat = own.select("region", "size", "z0", "nz")
    vox = pairs.where("next > z").join(sorted_join(lat), "region").withColumn("k", F.explode(_filled()))
    return vox.select("region", "i", "j", "k"), odd


def _pairs(triangles: DataFrame, own: DataFrame) -> DataFrame:
    """(region, i, j, z, next): each odd crossing of a column, and the one after it."""
    w = Window.partitionBy("region", "i", "j").orderBy("z", "tri_id")
    return crossings(triangles, own).select("region", "i", "j", "z", F.lead("z").over(w).alias("next"), F.row_number().over(w).alias("turn")).where("turn % 2 = 1").drop("turn")


def _filled() -> Column:
    """Lattice places whose centres lie above `z` and not above `next`; null if there are none."""
    return F.filter(_reach("z", F.col("z"), F.col("next")), lambda k: (_height(k) > F.col("z")) & (_height(k) <= F.col("next")))


def _height(k: Column) -> Column:
    return F.col("z0") + (k + 0.5) * F.col("size")


def voxel_report(triangles: DataFrame, *, size: float | None = None, padding: float = 0.0, most: int | None = None) -> DataFrame:
    """`lattices` with voxels inside, their volume, open columns, and status also `empty` (no centre inside) or `open`."""
    own = lattices(triangles, size=size, padding=padding, most=most)
    lat = own.select("region", "size", "z0", "nz")
    full = F.when(F.col("next") > F.col("z"), F.coalesce(F.size(_filled()), F.lit(0))).otherwise(0)
    found = _pairs(triangles, own).join(sorted_join(lat), "region").groupBy("region").agg(F.sum(F.greatest(full, F.lit(0)).cast("long")).alias("voxels"), F.count_if(F.col("next").isNull()).alias("open"))
    out = own.join(sorted_join(found), "region", "left").fillna(0, ["voxels", "open"])
    state = F.when(F.col("status") != "ok", F.col("status")).when(F.col("voxels") == 0, "empty").when(F.col("open") > 0, "open").otherwise("ok")
    return out.withColumns({"status": state, "volume": F.col("voxels") * F.pow("size", F.lit(3.0))})


def voxel_mesh(vox: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hexahedra (region, cell_id, cell_type, conn) of voxels and their nodes (region, node_id, x, y, z), shared within a region; ids are of the region's lattice."""
    c = {k: F.col(k) for k in ("i", "j", "k", "nx", "ny")}
    node = lambda di, dj, dk: ((c["k"] + dk) * (c["ny"] + 1) + c["j"] + dj) * (c["nx"] + 1) + c["i"] + di
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    lat = own.select("region", "size", "x0", "y0", "z0", "nx", "ny")
    cells = vox.join(sorted_join(lat.select("region", "nx", "ny")), "region").select(
        "region", ((c["k"] * c["ny"] + c["j"]) * c["nx"] + c["i"]).alias("cell_id"), F.lit("hex8").alias("cell_type"), F.array(*(node(*d) for d in corners)).alias("conn")
    )
    n, nx, ny = F.col("node_id"), F.col("nx") + 1, F.col("ny") + 1
    at = {"x": n % nx, "y": F.floor(n / nx) % ny, "z": F.floor(n / (nx * ny))}
    nodes = cells.select("region", F.explode("conn").alias("node_id")).distinct().join(sorted_join(lat), "region")
    return cells, nodes.select("region", "node_id", *((F.col(f"{k}0") + v * F.col("size")).alias(k) for k, v in at.items()))
