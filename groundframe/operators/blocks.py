"""Axis-aligned blocks (id, x0, x1, y0, y1, z0, z1, region): contacts, cuts and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import AXES, box_volume
from .tiles import spans, tiled_join

BOUNDS = [f"{k}{s}" for k in AXES for s in (0, 1)]


def block_contacts(blocks: DataFrame, *, tolerance: float = 1e-9, least_area: float = 0.0) -> DataFrame:
    """(axis, id_a, id_b, region_a, region_b, area): a's upper face touches b's lower one (JOIN-03).

    Faces meet if they lie within `tolerance`, scaled by the coordinate, of each other and overlap by more than
    `least_area`. The join is on the touching plane (rounded; both neighbouring roundings are probed) and on tiles of the
    two other axes, in levels by the faces' sizes.
    """
    out = []
    for k in AXES:
        u, v = (m for m in AXES if m != k)
        step = max(tolerance, 1e-9) * 1e3
        plane = lambda s: F.floor(F.col(f"{k}{s}") / step).cast("long")  # noqa: E731, B023
        named = lambda n: [F.col(c).alias(f"{n}_{c}") for c in ["id", "region", *BOUNDS]]
        a = blocks.select(F.explode(F.array(plane(1) - 1, plane(1), plane(1) + 1)).alias("p"), *named("a"))
        b = blocks.select(plane(0).alias("p"), *named("b"))
        near = F.abs(F.col(f"a_{k}1") - F.col(f"b_{k}0")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"a_{k}1")), F.abs(F.col(f"b_{k}0")))
        size = {m: F.least(f"a_{m}1", f"b_{m}1") - F.greatest(f"a_{m}0", f"b_{m}0") for m in (u, v)}
        hit = near & (size[u] > 0) & (size[v] > 0) & (size[u] * size[v] > least_area) & (F.col("a_id") != F.col("b_id"))
        out.append(tiled_join(a, b, spans("a_", [u, v]), spans("b_", [u, v]), ("p",)).where(hit).select(
            F.lit(k).alias("axis"), F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.col("a_region").alias("region_a"), F.col("b_region").alias("region_b"), (size[u] * size[v]).alias("area")
        ))
    return reduce(DataFrame.union, out)


def contact_assets(contacts: DataFrame) -> DataFrame:
    """Contacts by unordered pair of regions: count, area and axes; within one region the mode is tie (AGG-12, AGG-14)."""
    pair = contacts.withColumns({"low": F.least("region_a", "region_b"), "high": F.greatest("region_a", "region_b")})
    out = pair.groupBy("low", "high").agg(F.count("*").alias("contacts"), F.sum("area").alias("area"), *(F.count_if(F.col("axis") == k).alias(f"axis_{k}") for k in AXES))
    return out.withColumn("mode", F.when(F.col("low") == F.col("high"), "tie").otherwise("contact"))


def subtract_boxes(targets: DataFrame, cutters: DataFrame, *, tolerance: float = 1e-12) -> DataFrame:
    """`targets` minus one cutter each (a table of id and bounds), as up to six slabs: x, then y, then z (GEN-12).

    Targets without an overlapping cutter stay whole (part 0); slabs of `tolerance` volume or less are left out.
    """
    c = cutters.select("id", *(F.col(b).alias(f"c_{b}") for b in BOUNDS))
    both = targets.join(c, "id", "left")
    for k in AXES:
        both = both.withColumns({f"i_{k}0": F.greatest(f"{k}0", f"c_{k}0"), f"i_{k}1": F.least(f"{k}1", f"c_{k}1")})
    apart = F.coalesce(reduce(lambda x, y: x | y, (F.col(f"i_{k}0") >= F.col(f"i_{k}1") for k in AXES)), F.lit(True)) | F.col("c_x0").isNull()
    slabs, inner = [], {b: F.col(b) for b in BOUNDS}
    for n, k in enumerate(AXES):
        for s in (0, 1):
            box = dict(inner)
            box[f"{k}{1 - s}"] = F.col(f"i_{k}{s}")
            slabs.append(F.struct(F.lit(2 * n + s + 1).alias("part"), *(box[b].alias(b) for b in BOUNDS)))
        inner[f"{k}0"], inner[f"{k}1"] = F.col(f"i_{k}0"), F.col(f"i_{k}1")
    whole = F.struct(F.lit(0).alias("part"), *(F.col(b) for b in BOUNDS))
    parts = F.when(apart, F.array(whole)).otherwise(F.array(*slabs))
    rest = [x for x in targets.columns if x not in BOUNDS]
    out = both.select(*rest, F.explode(parts).alias("b")).select(*rest, "b.*")
    return out.where(box_volume() > tolerance)


def split_boxes(blocks: DataFrame, axis: str, at: float) -> DataFrame:
    """Blocks split at a coordinate: side 0 below, 1 above; blocks that it misses stay whole with side null (GEN-14, GEN-16, GEN-17)."""
    lo, hi = f"{axis}0", f"{axis}1"
    cut = (F.col(lo) < at) & (F.col(hi) > at)
    side = F.explode(F.when(cut, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(None).cast("int"))))
    out = blocks.withColumn("side", side)
    return out.withColumns({hi: F.when(F.col("side") == 0, F.lit(at)).otherwise(F.col(hi)), lo: F.when(F.col("side") == 1, F.lit(at)).otherwise(F.col(lo))})


def touching_regions(boxes: DataFrame, *, tolerance: float = 1e-9) -> DataFrame:
    """Pairs of boxes (a < b) that touch: every overlap is at least -tolerance and one is about zero (JOIN-05).

    The join is on tiles of all three axes, in levels by the boxes' sizes.
    """
    a, b = (boxes.select(*(F.col(c).alias(f"{n}_{c}") for c in ["id", *BOUNDS])) for n in "ab")
    over = [F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0") for k in AXES]
    hit = reduce(lambda x, y: x & y, (o >= -tolerance for o in over)) & reduce(lambda x, y: x | y, (F.abs(o) <= tolerance for o in over))
    both = tiled_join(a, b, spans("a_", AXES, tolerance), spans("b_", AXES, tolerance))
    return both.where(hit & (F.col("a_id") < F.col("b_id"))).select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"))
