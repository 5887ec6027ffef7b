"""Editing of outlines (outline, seq, x, y, z): edges, and points moved to earlier ones, to a grid or to right angles (PRJ-21)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .folds import waves


def closed_edges(points: DataFrame, *, close: bool = True) -> DataFrame:
    """(outline, k, start, end): edges between neighbours in order of seq, and from the last point to the first; `start` and `end` are seqs.

    Outlines of fewer than three points have none. A window orders an outline's points; none is gathered.
    """
    w = Window.partitionBy("outline").orderBy("seq")
    ends = points.groupBy("outline").agg(F.count("*").alias("n"), F.min("seq").alias("first")).where("n >= 3")
    e = points.select("outline", F.row_number().over(w).alias("k"), F.col("seq").alias("start"), F.lead("seq").over(w).alias("next")).join(ends, "outline")
    e = e.withColumn("end", F.coalesce("next", "first") if close else F.col("next"))
    return e.where("end is not null").select("outline", "k", "start", "end")


def snapped_to_grid(points: DataFrame, size: float) -> DataFrame:
    """x and y at the nearest multiple of `size`, halves to even."""
    h = max(1e-9, size)
    return points.withColumns({k: F.rint(F.col(k) / h) * h for k in "xy"})


def _sorted(points: DataFrame) -> tuple[DataFrame, list[StructField]]:
    """Points by outline, each outline in one partition and in order, and the fields of its keys."""
    rows = points.select("outline", "seq", *(F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in "xyz")).where("outline is not null and seq is not null")
    return rows.repartition("outline").sortWithinPartitions("outline", "seq"), [rows.schema["outline"], rows.schema["seq"]]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    outline = b.column("outline").to_pandas().to_numpy()
    return outline, *(b.column(k).to_numpy() for k in "xyz")


def orthogonal(points: DataFrame, prefer: str = "nearest") -> DataFrame:
    """(outline, seq, x, y, z, axis): each point moved level with or straight above the one before it, as that has been moved (PRJ-21).

    The longer part of the edge stays (x on a tie), or that along `prefer` (x or y). The first point stays, with a null axis. A point
    depends on all before it, so an outline is one sequence; its rows stream through in order, many outlines side by side in waves, and only the last
    point is carried from batch to batch. A null coordinate counts as 0; rows without an outline or seq are left out.
    """
    rows, keys = _sorted(points)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            outline, x, y, z = _columns(b)
            x, y, axis = x.copy(), y.copy(), np.full(len(x), None, object)
            slot = np.cumsum(np.r_[False, outline[1:] != outline[:-1]])
            at = np.full((slot[-1] + 1, 2), np.nan)
            if held is not None and outline[0] == last:
                at[0] = held
            for wave in waves(slot):
                px, py = at[slot[wave]].T
                first = np.isnan(px)
                level = np.abs(x[wave] - px) >= np.abs(y[wave] - py) if prefer not in ("x", "y") else np.full(len(wave), prefer == "x")
                y[wave] = np.where(~first & level, py, y[wave])
                x[wave] = np.where(~first & ~level, px, x[wave])
                axis[wave] = np.where(first, None, np.where(level, "x", "y"))
                at[slot[wave], 0], at[slot[wave], 1] = x[wave], y[wave]
            last, held = outline[-1], at[-1].copy()
            yield pa.RecordBatch.from_arrays([b.column("outline"), b.column("seq"), pa.array(x), pa.array(y), pa.array(z), pa.array(axis, pa.string())], names=["outline", "seq", "x", "y", "z", "axis"])

    return rows.mapInArrow(fold, StructType([*keys, *StructType.fromDDL("x double, y double, z double, axis string")]))


def snapped_to_earlier(points: DataFrame, tolerance: float) -> DataFrame:
    """(outline, seq, x, y, z, snapped_to): each point moved to the first earlier one of its outline within `tolerance` in x and y (PRJ-21).

    Earlier points count where they have been moved to. As a moved point lies on one that stayed, the first one within reach is always one that
    stayed, so only these are kept, in a grid of the tolerance's size; a point looks into nine cells. A point keeps its own z unless that is 0; it
    then takes the other's. An outline's rows stream through in order; memory holds the points that stay of one outline at a time. A null coordinate counts as 0; rows
    without an outline or seq are left out.
    """
    rows, keys = _sorted(points)
    tol = max(0.0, tolerance)
    cell = tol or 1e-9

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stayed, count = None, {}, 0
        for b in batches:
            seqs = b.column("seq")
            outline, x, y, z = _columns(b)
            x, y, z, to = x.copy(), y.copy(), z.copy(), [None] * b.num_rows
            for i in range(b.num_rows):
                if last is None or outline[i] != last:
                    last, stayed, count = outline[i], {}, 0
                cx, cy = int(np.floor(x[i] / cell)), int(np.floor(y[i] / cell))
                near = [p for u in (cx - 1, cx, cx + 1) for v in (cy - 1, cy, cy + 1) for p in stayed.get((u, v), ()) if (x[i] - p[1]) ** 2 + (y[i] - p[2]) ** 2 <= tol * tol]
                if near:
                    _, x[i], y[i], pz, to[i] = min(near)
                    z[i] = z[i] or pz
                else:
                    stayed.setdefault((cx, cy), []).append((count, x[i], y[i], z[i], seqs[i].as_py()))
                    count += 1
            yield pa.RecordBatch.from_arrays([b.column("outline"), seqs, pa.array(x), pa.array(y), pa.array(z), pa.array(to, seqs.type)], names=["outline", "seq", "x", "y", "z", "snapped_to"])

    return rows.mapInArrow(fold, StructType([*keys, *StructType.fromDDL("x double, y double, z double"), StructField("snapped_to", keys[1].dataType)]))
