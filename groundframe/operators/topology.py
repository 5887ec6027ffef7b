"""Topology of blocks: solids, faces, edges and vertices, face contacts, lineage, bindings, policies and hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks_for
from . import geometry as g
from .tiles import sorted_join, spans, tiled_join

#: A box's corners (0: low, 1: high bound of each axis) in the order of a hexahedron's nodes, its faces and its edges by corner.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
BOX_FACES = {"x0": (0, 4, 7, 3), "x1": (1, 2, 6, 5), "y0": (0, 1, 5, 4), "y1": (3, 7, 6, 2), "z0": (0, 3, 2, 1), "z1": (4, 5, 6, 7)}
BOX_EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]


def corners(digits: int = 9) -> Column:
    """A box's corner points, rounded, so that equal ones of different boxes are one vertex."""
    at = lambda k, s: F.round(F.col(f"{k}{s}"), digits) + F.lit(0.0)
    return F.array(*(g.point(*(at(k, s) for k, s in zip(g.AXES, c, strict=True))) for c in CORNERS))


def topology_counts(boxes: DataFrame, digits: int = 9) -> DataFrame:
    """(kind, entities, shared): solids, faces, edges and vertices of boxes, each distinct one once, and how many belong to several boxes (GEN-19, GEN-32, JOIN-19)."""
    c = boxes.select("id", corners(digits).alias("c"))
    p = F.col("c")
    # the first and last corner of an entity stand for all of its corners
    ends = lambda *x: F.struct(F.array_min(F.array(*x)).alias("lo"), F.array_max(F.array(*x)).alias("hi"))
    parts = {"face": [ends(*(p[i] for i in f)) for f in BOX_FACES.values()], "edge": [ends(p[a], p[b]) for a, b in BOX_EDGES], "vertex": [F.struct(p[i].alias("lo")) for i in range(8)]}
    tasks = tasks_for(boxes)
    out = [boxes.agg(F.lit("solid").alias("kind"), F.count("*").alias("entities"), F.lit(0).cast("long").alias("shared"))]
    for kind, of in parts.items():
        keys = [f"{end}_{k}" for end in (("lo",) if kind == "vertex" else ("lo", "hi")) for k in g.AXES]
        each = c.select("id", F.explode(F.array(*of)).alias("e")).select("id", *(F.col(f"e.{k[:2]}.{k[3:]}").alias(k) for k in keys))
        n = each.repartition(tasks, *keys).groupBy(*keys).agg((F.min("id") != F.max("id")).alias("shared"))
        out.append(n.agg(F.lit(kind).alias("kind"), F.count("*").alias("entities"), F.count_if("shared").alias("shared")))
    return reduce(DataFrame.union, out)


def shared_node_cells(boxes: DataFrame, digits: int = 9, least: float = 1e-12) -> DataFrame:
    """One hexahedron a box with corner points as nodes, those of neighbours shared by rounded coordinates; boxes of `least` volume or less are left out (SET-08, GEN-24)."""
    return boxes.where(g.box_volume() > least).select(F.col("id").alias("cell_id"), "region", corners(digits).alias("conn"))


def region_nodes(cells: DataFrame, tasks: int) -> DataFrame:
    """(region, corners, nodes): corners of a region's cells, and its distinct nodes, counted in `tasks` tasks by region and place (SET-08)."""
    keys = ["region", *(f"n_{k}" for k in g.AXES)]
    each = cells.select("region", F.explode("conn").alias("n")).select("region", *(F.col(f"n.{k}").alias(f"n_{k}") for k in g.AXES))
    met = each.repartition(tasks, *keys).groupBy(*keys).agg(F.count("*").alias("uses"))
    return met.groupBy("region").agg(F.sum("uses").alias("corners"), F.count("*").alias("nodes"))


def box_faces(boxes: DataFrame) -> DataFrame:
    """Six faces a box: (id, region, label, axis, side, at, u0, u1, v0, v1); side -1 faces down its axis, 1 up."""
    rows = []
    for label in BOX_FACES:
        k, s = label
        u, v = (m for m in g.AXES if m != k)
        rows.append(F.struct(F.lit(label).alias("label"), F.lit(k).alias("axis"), F.lit(2 * int(s) - 1).alias("side"), F.col(label).alias("at"), F.col(f"{u}0").alias("u0"), F.col(f"{u}1").alias("u1"), F.col(f"{v}0").alias("v0"), F.col(f"{v}1").alias("v1")))
    return boxes.select("id", "region", F.explode(F.array(*rows)).alias("f")).select("id", "region", "f.*")


def face_contacts(boxes: DataFrame, *, tolerance: float = 1e-7, least_area: float = 1e-10) -> DataFrame:
    """(id_a, id_b, label_a, label_b, area): faces of different boxes that look at each other in one plane and overlap (JOIN-04).

    Only faces up an axis meet those down it. The join is on the axis, the plane (both neighbouring roundings are probed) and
    tiles of the face's own plane, in levels by the faces' sizes.
    """
    f = box_faces(boxes)
    step = tolerance * 1e3
    names = ["id", "label", "at", "u0", "u1", "v0", "v1"]
    up = f.where("side = 1").withColumn("p", F.floor(F.col("at") / step)).select("axis", "p", *(F.col(c).alias(f"a_{c}") for c in names))
    down = f.where("side = -1").withColumn("p", F.explode(F.array(*(F.floor(F.col("at") / step) + d for d in (-1, 0, 1))))).select("axis", "p", *(F.col(c).alias(f"b_{c}") for c in names))
    size = {m: F.least(f"a_{m}1", f"b_{m}1") - F.greatest(f"a_{m}0", f"b_{m}0") for m in "uv"}
    near = F.abs(F.col("a_at") - F.col("b_at")) <= tolerance * F.greatest(F.lit(1.0), F.abs("a_at"), F.abs("b_at"))
    hit = near & (size["u"] > 0) & (size["v"] > 0) & (size["u"] * size["v"] > least_area) & (F.col("a_id") != F.col("b_id"))
    both = tiled_join(up, down, spans("a_", "uv"), spans("b_", "uv"), ("axis", "p")).where(hit)
    return both.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.col("a_label").alias("label_a"), F.col("b_label").alias("label_b"), (size["u"] * size["v"]).alias("area"))


def contact_assembly(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """By interface: node pairs (interface, slave, master, area) of which both nodes are among the active `nodes` (node_id), of no area, or with a node missing (JOIN-15)."""
    n = nodes.select(F.col("node_id")).distinct()
    out = pairs.join(n.select(F.col("node_id").alias("s")), F.col("slave") == F.col("s"), "left").join(n.select(F.col("node_id").alias("m")), F.col("master") == F.col("m"), "left")
    both = F.col("s").isNotNull() & F.col("m").isNotNull()
    return out.groupBy("interface").agg(
        F.count("*").alias("pairs"), F.count_if(both & (F.col("area") > 0)).alias("effective"), F.count_if(both & ~F.coalesce(F.col("area") > 0, F.lit(False))).alias("zero"), F.count_if(~both).alias("missing")
    )


def bind_entities(entities: DataFrame, materials: DataFrame, phases: DataFrame) -> DataFrame:
    """(entity, kind, owner, material, phases, status) of topology entities (entity, kind, owner): their owner's material and phases (JOIN-18).

    `materials`: (owner, material), the alphabetically first counts; `phases`: (owner, phase). Edges take no material.
    """
    m = materials.groupBy("owner").agg(F.min("material").alias("material"))
    p = phases.select("owner", "phase").distinct().groupBy("owner").agg(F.count("*").alias("phases"))
    out = entities.join(m, "owner", "left").join(p, "owner", "left").fillna(0, ["phases"])
    out = out.withColumn("material", F.when(F.col("kind") != "edge", F.col("material")))
    status = F.when((F.col("kind") == "solid") & F.col("material").isNull(), "unbound").when(F.col("phases") == 0, "no_phase").otherwise("bound")
    return out.select("entity", "kind", "owner", "material", "phases", status.alias("status"))


def lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, old_id, type): where each entity of an operation's result comes from (JOIN-24, VAL-14).

    Entities have op, kind, id, name, plane and bounds. Equal names within an operation and kind match first (the smallest old id);
    else the old one whose bounds overlap most (a tenth of a point for each unit of volume, ten more for the same plane). An old entity with
    one descendant is preserved, with several split; a new entity without an origin is generated. Boxes meet on tiles in levels by their
    sizes, so an operation with many entities is no all-pairs join.
    """
    box = [f"{k}{s}" for k in g.AXES for s in (0, 1)]
    o = old.select("op", "kind", F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("plane").alias("old_plane"), *(F.col(b).alias(f"o_{b}") for b in box))
    named = new.join(sorted_join(o.select("op", "kind", "old_id", F.col("old_name").alias("name"))), ["op", "kind", "name"]).groupBy("id").agg(F.min("old_id").alias("by_name"))
    rest = new.join(sorted_join(named), "id", "left_anti")
    over = reduce(lambda x, y: x * y, (F.greatest(F.lit(0.0), F.least(f"{k}1", f"o_{k}1") - F.greatest(f"{k}0", f"o_{k}0")) for k in g.AXES))
    score = over / 10 + F.when(F.col("plane") == F.col("old_plane"), 10.0).otherwise(0.0)
    there = rest.select("op", "kind", "id", "plane", *box)
    near = tiled_join(there, o.drop("old_name"), spans("", g.AXES), spans("o_", g.AXES), ("op", "kind")).withColumn("score", score).where(over > 0).groupBy("id").agg(F.min_by("old_id", F.struct(-F.col("score"), F.col("old_id"))).alias("by_box"))
    out = new.select("id").join(sorted_join(named), "id", "left").join(sorted_join(near), "id", "left").select(F.col("id").alias("new_id"), F.coalesce("by_name", "by_box").alias("old_id"))
    many = out.where("old_id is not null").groupBy("old_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("old_id").isNull(), "generated").when(F.col("n") > 1, "split").otherwise("preserved")
    return out.join(sorted_join(many), "old_id", "left").select("new_id", "old_id", kind.alias("type"))


def closest_blocks(old: DataFrame, new: DataFrame, reach: float) -> DataFrame:
    """(old_id, new_id, distance): each old block's nearest new one by centre within `reach`, one of the same role before all others (JOIN-29, MUT-16).

    Blocks are (id, role, x, y, z). The join is on cells of the reach's size.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    o = old
    for k in g.AXES:
        o = o.withColumn(f"c{k}", F.explode(F.array(*(cell(k) + d for d in (-1, 0, 1)))))
    n = new.select(F.col("id").alias("new_id"), F.col("role").alias("new_role"), *(F.col(k).alias(f"n{k}") for k in g.AXES), *(cell(k).alias(f"c{k}") for k in g.AXES))
    d = F.sqrt(reduce(lambda a, b: a + b, ((F.col(k) - F.col(f"n{k}")) ** 2 for k in g.AXES)))
    both = o.join(sorted_join(n), [f"c{k}" for k in g.AXES]).withColumn("distance", d).where(F.col("distance") <= reach)
    best = both.groupBy(F.col("id").alias("old_id")).agg(F.min(F.struct((~F.col("role").eqNullSafe(F.col("new_role"))).alias("other"), "distance", "new_id")).alias("b"))
    return best.select("old_id", "b.new_id", "b.distance", F.col("b.other").alias("other_role"))


def mesh_policies(edges: DataFrame, pairs: DataFrame, rows: DataFrame, protected: DataFrame) -> DataFrame:
    """(name, policy, source): one policy an edge name; a contact pair's overrides an edge's, an explicit row's both, and a protected surface counts
    only where nothing else does (JOIN-20, JOIN-21).

    Each table is (name, policy); of several rows of one source the alphabetically first counts.
    """
    ranked = [t.select("name", "policy", F.lit(s).alias("source"), F.lit(r).alias("rank")) for r, (s, t) in enumerate((("row", rows), ("pair", pairs), ("edge", edges), ("protected", protected)))]
    return reduce(DataFrame.union, ranked).groupBy("name").agg(F.min(F.struct("rank", "policy", "source")).alias("m")).select("name", "m.policy", "m.source")


def hops(edges: DataFrame, nodes: DataFrame, relations: list[str], *, outgoing: bool = True) -> DataFrame:
    """(node, other, relation): directed neighbours of `nodes` (node) by relation (GRA-04, GRA-05, JOIN-22)."""
    a, b = ("source", "target") if outgoing else ("target", "source")
    e = edges.where(F.col("relation").isin(relations)).select(F.col(a).alias("node"), F.col(b).alias("other"), "relation").distinct()
    return e.join(nodes.select("node").distinct(), "node", "left_semi")


def size_field(surfaces: DataFrame, factors: DataFrame, controls: DataFrame, size: float) -> DataFrame:
    """(surface, size, source): element sizes near surfaces (surface, role): `size` by the role's factor, or a user's own by name; given only where the factor
    is below 0.999 or a user said so (SPA-06)."""
    f = factors.groupBy("role").agg(F.min("factor").alias("factor"))
    c = controls.groupBy("surface").agg(F.min("size").alias("own"))
    out = surfaces.join(f, "role", "left").join(c, "surface", "left").fillna(1.0, ["factor"])
    out = out.where((F.col("factor") < 0.999) | F.col("own").isNotNull())
    return out.select("surface", F.coalesce("own", F.col("factor") * size).alias("size"), F.when(F.col("own").isNotNull(), "user").otherwise("role").alias("source"))


def unique_names(target: DataFrame, source: DataFrame) -> DataFrame:
    """Volumes of two projects as one: (name, origin, given): a name that is taken, by `target` or by an earlier row of `source`, gets _2, _3, ... (SET-12).

    Rows are (name, seq); `target`'s names stay. Numbers are counted by name, so a name that already ends in such a suffix is a name of its own.
    """
    rows = target.select("name", F.lit(0).alias("origin"), "seq").union(source.select("name", F.lit(1).alias("origin"), "seq"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("origin", "seq"))
    return rows.select("origin", "seq", F.col("name").alias("given"), F.when((n > 1) & (F.col("origin") == 1), F.concat("name", F.lit("_"), n.cast("string"))).otherwise(F.col("name")).alias("name"))
