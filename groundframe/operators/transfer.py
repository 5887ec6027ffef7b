"""Matching of old and new entities, bindings, selections and merges of models."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tiles import sorted_join, spans, tiled_join

#: Points for each equal attribute of an old and a new entity, and for being near; from AUTO on a match needs no review.
SCORES = {"fingerprint": 10.0, "key": 5.0, "feature": 3.0, "kind": 2.0, "role": 1.0}
NEAR, AUTO, SURE = 2.0, 6.0, 8.0


def best_matches(old: DataFrame, new: DataFrame, *, reach: float, blocks: tuple[str, ...] = ("fingerprint", "key", "feature")) -> DataFrame:
    """(old_id, new_id, score, status): each old entity's best new one (JOIN-10).

    Entities have id, x, y, z and the attributes of SCORES. Candidates agree in one of `blocks`, so the joins are on
    equality; kinds, roles and distance only add points. Ties go to the smaller new id. Status is auto, review (below
    SURE), or weak (below AUTO).

    There is a join for each set of blocks, which counts its own blocks' points and no other's. All points are above zero, so
    the best pair has its whole score in the join of all the blocks that it agrees in, and no pair has more than its own
    in any. For a join, new entities that agree in all that it looks at are one, the one of the smallest id; so an old entity meets as
    many as there are such places, however many entities there are. The best scores are found first and their
    ids in a second pass over the joins that reach them: an aggregate of a score and an id together would sort all pairs.
    """
    sets = [s for k in range(1, len(blocks) + 1) for s in combinations(blocks, k)]
    rest = [c for c in SCORES if c not in blocks]
    o = old.select(*(F.col(c).alias(f"old_{c}") for c in ("id", "x", "y", "z", *SCORES)))
    best = reduce(DataFrame.union, (_scored(o, new, s, rest, reach).groupBy("old_id").agg(F.min("less").alias("less")).withColumn("i", F.lit(i)) for i, s in enumerate(sets)))
    best = best.groupBy("old_id").agg(F.min("less").alias("best"), *(F.min(F.when(F.col("i") == i, F.col("less"))).alias(f"less_{i}") for i in range(len(sets))))
    known = o.join(sorted_join(best.withColumnRenamed("old_id", "best_id")), F.col("old_id").eqNullSafe(F.col("best_id")))
    pairs = (_scored(known.where(F.col(f"less_{i}") == F.col("best")), new, s, rest, reach).where(F.col("less") == F.col("best")).select("old_id", "best", "new_id") for i, s in enumerate(sets))
    found = reduce(DataFrame.union, pairs).groupBy("old_id", "best").agg(F.min("new_id").alias("new_id")).withColumn("score", -F.col("best"))
    status = F.when(F.col("score") < AUTO, "weak").when(F.col("score") < SURE, "review").otherwise("auto")
    return found.select("old_id", "new_id", "score", status.alias("status"))


def _scored(old: DataFrame, new: DataFrame, blocks: tuple[str, ...], rest: list[str], reach: float) -> DataFrame:
    """`old` with new_id and less (its score below zero) for each place of new entities that agree in `blocks`."""
    n = new.groupBy(*blocks, *rest, "x", "y", "z").agg(F.min("id").alias("id"))
    n = n.select(*(F.col(c).alias(f"new_{c}") for c in n.columns))
    same = lambda c: F.col(f"old_{c}") == F.col(f"new_{c}")
    score = reduce(lambda s, c: s + F.when(same(c), SCORES[c]).otherwise(0.0), rest, F.lit(sum(SCORES[c] for c in blocks)))
    d = F.sqrt(sum(((F.col(f"old_{k}") - F.col(f"new_{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    less = -(score + F.greatest(F.lit(0.0), NEAR * (1 - d / reach)))
    return old.join(sorted_join(n), reduce(and_, map(same, blocks))).withColumn("less", less)


def review_queue(matches: DataFrame) -> DataFrame:
    """`best_matches` rows with `queue`: invalid without a new entity, review if weak or below SURE, else auto (FLT-19)."""
    queue = F.when(F.col("new_id").isNull(), "invalid").when((F.col("status") != "auto") | (F.col("score") < AUTO), "review").otherwise("auto")
    return matches.withColumn("queue", queue)


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(old_id, new_id, state) after a review: accept takes the match, map takes the decision's own target, any other decision
    rejects; without one, auto matches are taken and the others wait (FLT-20). The latest decision by `seq` counts.
    """
    last = decisions.groupBy("old_id").agg(F.max_by(F.struct("action", "target"), "seq").alias("d"))
    out = queue.join(last, "old_id", "left")
    action = F.col("d.action")
    state = F.when(action == "accept", "accepted").when(action == "map", "mapped").when(F.col("d").isNotNull(), "rejected").when(F.col("queue") == "auto", "accepted").otherwise("waiting")
    new = F.when(state == "accepted", F.col("new_id")).when(state == "mapped", F.col("d.target"))
    return out.select("old_id", new.alias("new_id"), state.alias("state"))


def transfer_bindings(bindings: DataFrame, names: DataFrame) -> DataFrame:
    """(binding, target, name, how): bindings to entities by name, carried over to new names: exact, else all names that begin
    with the target up to a colon, else unmatched (JOIN-11). Names are matched by all their beginnings, so the join is on equality.
    """
    parts = F.split("name", ":", -1)
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ":"))
    known = names.select("name").distinct().select("name", F.explode(begins).alias("target"))
    both = bindings.join(known, "target", "left")
    exact = both.groupBy("binding").agg(F.bool_or(F.col("name") == F.col("target")).alias("exact"))
    both = both.join(exact, "binding").where("name is null or not coalesce(exact, false) or name = target")
    how = F.when(F.col("name").isNull(), "unmatched").when(F.col("name") == F.col("target"), "exact").otherwise("contains")
    return both.select("binding", "target", "name", how.alias("how")).distinct()


def materials_for(regions: DataFrame, materials: DataFrame, families: tuple[str, ...] = ("soil", "wall")) -> DataFrame:
    """(region, material): the material of the region's name, else the first of its family's prefix (FLT-02)."""
    exact = materials.select(F.col("name").alias("region"), F.col("name").alias("exact"))
    prefix = lambda c: reduce(lambda s, f: F.when(F.col(c).startswith(f), F.lit(f)).otherwise(s), families, F.lit(None).cast("string"))
    family = materials.select(prefix("name").alias("family"), "name").where("family is not null").groupBy("family").agg(F.min("name").alias("fallback"))
    out = regions.select("region").distinct().withColumn("family", prefix("region")).join(exact, "region", "left").join(family, "family", "left")
    return out.select("region", F.coalesce("exact", "fallback").alias("material"))


def merge_regions(cells: DataFrame, names: list[str], target: str) -> DataFrame:
    """`cells` with the regions in `names` as one; a cell stays once (AGG-24, MUT-10)."""
    return cells.withColumn("region", F.when(F.col("region").isin(names), target).otherwise(F.col("region"))).dropDuplicates(["region", "cell_id"])


def combine(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two meshes (cells, nodes) as one: ids of the second go on from the first's greatest (SET-01, SET-02)."""
    (ca, na), (cb, nb) = first, second
    top = ca.agg(F.coalesce(F.max("cell_id") + 1, F.lit(0)).alias("c0")).crossJoin(na.agg(F.coalesce(F.max("node_id") + 1, F.lit(0)).alias("n0")))  # one row
    cb = cb.join(F.broadcast(top)).withColumns({"cell_id": F.col("cell_id") + F.col("c0"), "conn": F.expr("transform(conn, v -> v + n0)")}).drop("c0", "n0")
    nb = nb.join(F.broadcast(top)).withColumn("node_id", F.col("node_id") + F.col("n0")).drop("c0", "n0")
    return ca.unionByName(cb), na.unionByName(nb)


def phase_elements(cells: DataFrame, activity: DataFrame, materials: DataFrame) -> DataFrame:
    """Cells of active regions in each phase, with their materials; surface cells are left out (JOIN-12).

    `activity`: (phase, region, is_active); `materials`: (region, material).
    """
    solid = cells.where(~F.col("cell_type").isin("tri3", "quad4"))
    return activity.where("is_active").select("phase", "region").join(solid, "region").join(materials.select("region", "material"), "region", "left")


def phase_summary(elements: DataFrame) -> DataFrame:
    """Per phase: cells, distinct nodes, cells without a material."""
    nodes = elements.select("phase", F.explode("conn").alias("n")).distinct().groupBy("phase").agg(F.count("*").alias("nodes"))
    own = elements.groupBy("phase").agg(F.count("*").alias("cells"), F.count_if(F.col("material").isNull()).alias("unmapped"))
    return own.join(nodes, "phase")


def compact_nodes(elements: DataFrame) -> DataFrame:
    """(phase, node_id, new_id): node ids numbered through from 0 in each phase.

    Ranks are counted within ranges of ids first and ranges are offset by the counts before them, so that no task sees a
    whole phase.
    """
    span = 1 << 16
    n = elements.select("phase", F.explode("conn").alias("node_id")).distinct().withColumn("part", F.floor(F.col("node_id") / span))
    before = n.groupBy("phase", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("phase").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("phase", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("phase", "part").orderBy("node_id")) - 1
    return n.withColumn("own", own).join(before, ["phase", "part"]).select("phase", "node_id", (F.col("base") + F.col("own")).alias("new_id"))


def nodal_forces(faces: DataFrame) -> DataFrame:
    """(node_id, fx, fy, fz) from faces (conn, area, tx, ty, tz): traction times area, shared alike by a face's nodes (AGG-27, NUM-13)."""
    share = faces.withColumn("n", F.size("conn")).withColumn("node_id", F.explode("conn"))
    return share.groupBy("node_id").agg(*(F.sum(F.col(f"t{k}") * F.col("area") / F.col("n")).alias(f"f{k}") for k in "xyz"))


def spacing(points: DataFrame, digits: int = 6) -> DataFrame:
    """One row: along each axis, the least gap above 1e-9 between distinct rounded coordinates (WIN-09).

    Gaps within ranges of coordinates and between ranges are found apart, so no task sorts all coordinates.
    """
    out = None
    for k in "xyz":
        v = points.select(F.bround(k, digits).alias("v")).distinct().withColumn("part", F.floor("v"))
        inner = v.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy("part").orderBy("v"))).select("gap")
        ends = v.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("block", F.floor(F.col("part") / 1024))
        within = ends.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.partitionBy("block").orderBy("part"))).select("gap")
        blocks = ends.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        across = blocks.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("block"))).select("gap")
        row = inner.union(within).union(across).where("gap > 1e-9").agg(F.min("gap").alias(f"d{k}"))
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


def node_sets(nodes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(set, node_id): nodes within `tolerance` of the six planes of their box, xmin to zmax (SPA-08)."""
    box = nodes.agg(*(f(k).alias(f"{k}{s}") for k in "xyz" for s, f in (("min", F.min), ("max", F.max))))
    sides = F.array(*(F.when(F.abs(F.col(k) - F.col(f"{k}{s}")) <= tolerance, F.lit(f"{k}{s}")) for k in "xyz" for s in ("min", "max")))
    return nodes.join(F.broadcast(box)).select(F.explode(F.array_compact(sides)).alias("set"), "node_id")  # the box is one row


def intersection_candidates(triangles: DataFrame) -> DataFrame:
    """(id_a, id_b) of triangles (cell_id, conn, pts) whose boxes overlap and that share no node (JOIN-06), from tiles of space in levels by their sizes."""
    lim = {f"{k}{s}": f(F.transform("pts", _axis(k))) for k in "xyz" for s, f in ((0, F.array_min), (1, F.array_max))}
    t = triangles.withColumns(lim)
    names = ["cell_id", "conn", *(f"{k}{s}" for k in "xyz" for s in (0, 1))]
    a, b = (t.select(*(F.col(c).alias(f"{n}_{c}") for c in names)) for n in "ab")
    hit = (F.col("a_cell_id") < F.col("b_cell_id")) & ~F.arrays_overlap("a_conn", "b_conn")
    return tiled_join(a, b, spans("a_", "xyz"), spans("b_", "xyz")).where(hit).select(F.col("a_cell_id").alias("id_a"), F.col("b_cell_id").alias("id_b"))


def _axis(k: str):
    return lambda q: q[k]
