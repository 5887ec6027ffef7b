"""Triangulated surfaces in STL, text or binary (SRC-05 to SRC-09), and their writer (SNK-05)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators.mesh import merge_nodes
from .splits import SIZE, opened, ranges, taken

_RECORD = np.dtype([("n", "<3f4"), ("v", "<9f4"), ("a", "<u2")])
_CORNERS = [f"{k}{i}" for i in range(3) for k in "xyz"]


def is_binary_head(head: bytes, length: int) -> bool:
    """By a file's first bytes (84 at least, if it has them) and its length: a size of 84 + 50 * count decides; otherwise whatever doesn't start with solid is binary (SRC-09)."""
    if len(head) >= 84 and length == 84 + 50 * int.from_bytes(head[80:84], "little"):
        return True
    return not head.lstrip()[:5].lower() == b"solid"


_WORD = re.compile(rb"(?i)\b(end)?facet\b")
_VERTEX = re.compile(rb"(?i)vertex\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)")


def text_facets(file, start: int, stop: int, length: int, step: int = 1 << 16) -> Iterator[tuple[int, list[float]]]:
    """(place, nine coordinates) of the text facets that begin in [start, stop): from the last `facet` before an `endfacet`."""
    lo, hi = max(0, start - 1), min(length, stop + step)
    data = taken(file, lo, hi)
    while True:  # on to the end of the last facet that begins here
        words = [(lo + m.start(), m) for m in _WORD.finditer(data) if m.start() > 0 or lo == 0]
        past = next((at for at, m in words if at >= stop), None)
        if past is not None or hi >= length:
            break
        data, hi = data + taken(file, hi, min(length, hi + step)), min(length, hi + step)
    begin = None
    for at, m in words:
        if m[1] is None:
            if at >= stop:
                return
            begin = (at, m.end())
        elif begin is not None:
            v = _VERTEX.findall(data, begin[1], m.start())
            if len(v) == 3:
                yield begin[0], [float(x) for p in v for x in p]
            begin = None


def read_facets(spark: SparkSession, path: str, scale: float = 1.0, size: int = SIZE) -> DataFrame:
    """(source, facet, x0 .. z2) of every STL file under `path`, each read in ranges of about `size` bytes by tasks of their own (SRC-06 to SRC-08).

    `facet` numbers a binary file's records; in a text file it is the place of the facet's first byte, which ascends as well. A range has the facets that
    begin in it, so the rows are the same for any size. A file's first bytes and its length tell each task whether it is binary.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, length, start, stop in zip(b["source"], b["length"], b["start"], b["stop"], strict=True):
                with opened(name) as file:
                    head = taken(file, 0, min(length, 1024))
                    if is_binary_head(head, length):
                        n = min(int.from_bytes(head[80:84], "little"), max(0, length - 84) // 50) if length >= 84 else 0
                        first, last = (min(n, max(0, -(-(x - 84) // 50))) for x in (start, stop))
                        for s in range(first, last, 100_000):
                            k = min(last - s, 100_000)
                            rows = np.frombuffer(taken(file, 84 + 50 * s, 84 + 50 * (s + k)), _RECORD)["v"].astype(float)
                            yield _part(name, np.arange(s, s + k), rows * scale)
                        continue
                    places, rows = [], []
                    for at, row in text_facets(file, start, stop, length):
                        places.append(at)
                        rows.append(row)
                        if len(rows) == 100_000:
                            yield _part(name, places, np.array(rows) * scale)
                            places, rows = [], []
                    if rows:
                        yield _part(name, places, np.array(rows) * scale)

    return ranges(spark, path, size).mapInPandas(parse, "source string, facet long, " + ", ".join(f"{c} double" for c in _CORNERS))


def _part(name: str, places, rows: np.ndarray) -> pd.DataFrame:
    part = pd.DataFrame(rows, columns=_CORNERS)
    part.insert(0, "facet", places)
    part.insert(0, "source", name)
    return part


def to_mesh(facets: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(triangles, nodes) of one surface: vertices within rounding of `tolerance` are one; node ids are 3 * facet + corner of the first."""
    corner = F.explode(F.array(*(F.struct((F.col("facet") * 3 + i).alias("node_id"), *(F.col(f"{k}{i}").alias(k) for k in "xyz")) for i in range(3))))
    nodes = merge_nodes(facets.select(corner.alias("c")).select("c.*"), tolerance)
    flat = nodes.select(F.floor(F.col("node_id") / 3).alias("cell_id"), (F.col("node_id") % 3).alias("at"), "new_id")
    conn = flat.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("at", "new_id"))).alias("c"))
    triangles = conn.select("cell_id", F.lit("tri3").alias("cell_type"), F.transform("c", lambda x: x["new_id"]).alias("conn"), F.lit("surface").alias("region"))
    return triangles, nodes.select(F.col("new_id").alias("node_id"), "x", "y", "z").distinct()


def quality(facets: DataFrame) -> DataFrame:
    """One row: triangles, degenerate ones (area up to 1e-14), area and signed volume (AGG-04)."""
    p = F.array(*(g.point(*(F.col(f"{k}{i}") for k in "xyz")) for i in range(3)))
    area, vol = g.triangle_area(p[0], p[1], p[2]), g.dot(p[0], g.cross(p[1], p[2])) / 6
    return facets.agg(F.count("*").alias("triangles"), F.count_if(area <= 1e-14).alias("degenerate"), F.sum(area).alias("area"), F.sum(vol).alias("volume"))


def stl_lines(facets: DataFrame, name: str = "surface") -> DataFrame:
    """(n, line): a text STL in order; write sorted by n (SNK-05)."""
    c = F.col
    side = {(k, i): c(f"{k}{i}") - c(f"{k}0") for k in "xyz" for i in (1, 2)}
    turn = {k: side[u, 1] * side[v, 2] - side[v, 1] * side[u, 2] for k, (u, v) in zip("xyz", ("yz", "zx", "xy"), strict=True)}
    own = facets.withColumns({f"n{k}": v for k, v in turn.items()}).withColumn("size", F.sqrt(c("nx") ** 2 + c("ny") ** 2 + c("nz") ** 2))
    unit = [F.when(c("size") > 0, c(f"n{k}") / c("size")).otherwise(0.0) for k in "xyz"]
    row = lambda *v: F.format_string("%.9g %.9g %.9g", *v)
    body = F.array(F.concat(F.lit("facet normal "), row(*unit)), F.lit("outer loop"), *(F.concat(F.lit("vertex "), row(*(c(f"{k}{i}") for k in "xyz"))) for i in range(3)), F.lit("endloop"), F.lit("endfacet"))
    lines = own.select("facet", F.posexplode(body).alias("at", "line")).select((c("facet") * 8 + c("at")).alias("n"), "line")
    spark = facets.sparkSession
    ends = spark.createDataFrame([(-1, f"solid {name}"), (1 << 62, f"endsolid {name}")], "n long, line string")
    return lines.union(ends)


def write_lines(lines: DataFrame, path: str) -> None:
    """(n, line) as text parts that follow each other in order."""
    lines.repartitionByRange("n").sortWithinPartitions("n").select("line").write.mode("error").text(path)


def latest_facets(facets: DataFrame) -> DataFrame:
    """Facets without copies: of equal sets of corners in a source, the first."""
    corners = F.array_sort(F.array(*(F.struct(*(F.col(f"{k}{i}").alias(k) for k in "xyz")) for i in range(3))))
    w = Window.partitionBy("source", "key").orderBy("facet")
    return facets.withColumn("key", corners).withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("key", "turn")
