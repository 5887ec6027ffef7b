"""Geological models in JSON (SRC-03, SRC-04), tetrahedral meshes in Gmsh 2 text and VTU, and legacy VTK out."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import SIZE, dealt, lines_of, opened, ranges

MODEL = """materials array<struct<id: string, model_type: string>>, surfaces array<struct<id: string, points: array<array<double>>>>,
volumes array<struct<id: string, bounds: array<double>, material_id: string>>, layers array<struct<id: string, volume_ids: array<string>, material_id: string>>,
boreholes array<struct<id: string, x: double, y: double, layers: array<struct<top: double, bottom: double, material_id: string>>>>"""
#: Cell types by their numbers in Gmsh 2 and in VTK.
GMSH_TYPES = {2: ("tri3", 3), 3: ("quad4", 4), 4: ("tet4", 4), 5: ("hex8", 8)}
VTK_TYPES = {5: "tri3", 9: "quad4", 10: "tet4", 12: "hex8", 13: "wedge6", 14: "pyramid5"}
_VTK_NUMBERS = {v: k for k, v in VTK_TYPES.items()}
MESH = "source string, kind string, id long, x double, y double, z double, cell_type string, conn array<long>, tag long"


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """materials, surface_points, volumes, layers and borehole_layers of one or more models; materials that are only
    referred to are added with the model type placeholder."""
    m = spark.read.schema(MODEL).json(path, multiLine=True).withColumn("model", F.input_file_name())
    each = lambda c: m.select("model", F.explode(c).alias("r")).select("model", "r.*")
    volumes, layers, holes = each("volumes"), each("layers"), each("boreholes")
    intervals = holes.select("model", F.col("id").alias("borehole_id"), "x", "y", F.posexplode("layers").alias("seq", "l")).select("model", "borehole_id", "x", "y", "seq", "l.*")
    used = volumes.select("model", "material_id").union(layers.select("model", "material_id")).union(intervals.select("model", "material_id")).where("material_id is not null").distinct()
    known = each("materials")
    extra = used.join(known.select("model", F.col("id").alias("material_id")), ["model", "material_id"], "left_anti").select("model", F.col("material_id").alias("id"), F.lit("placeholder").alias("model_type"))
    points = each("surfaces").select("model", F.col("id").alias("surface"), F.posexplode("points").alias("seq", "p")).select("model", "surface", "seq", *(F.get("p", F.lit(i)).alias(k) for i, k in enumerate("xyz")))
    bounds = [F.get("bounds", F.lit(i)).alias(f"{k}{s}") for i, (k, s) in enumerate((k, s) for k in "xyz" for s in (0, 1))]
    return {"materials": known.union(extra), "surface_points": points, "volumes": volumes.select("model", "id", "material_id", *bounds), "layers": layers, "borehole_layers": intervals}


def _gmsh_row(source: str, section: str | None, p: list[bytes]) -> tuple | None:
    """A line's row: a node, or a cell with its first (physical) tag."""
    if section == "Nodes" and len(p) == 4:
        return (source, "node", int(p[0]), *map(float, p[1:]), None, None, None)
    if section == "Elements" and len(p) > 3 and int(p[1]) in GMSH_TYPES:
        kind, n = GMSH_TYPES[int(p[1])]
        tags = int(p[2])
        return (source, "cell", int(p[0]), None, None, None, kind, [int(x) for x in p[3 + tags : 3 + tags + n]], int(p[3]) if tags else None)
    return None


def gmsh_table(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """Nodes and cells of Gmsh 2 text meshes as rows of MESH, read in ranges of bytes (SRC-12).

    A first pass finds the headings of sections ($...), a few rows a file; each range then knows in which section it begins. A
    range has the lines that begin in it, so the rows are the same for any size.
    """

    def headings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, length, start, stop in zip(b["source"], b["length"], b["start"], b["stop"], strict=True):
                with opened(name) as file:
                    at, data = lines_of(file, start, stop, length)
                rows += [(name, at + m.start(), m[1].decode(errors="replace").strip()) for m in re.finditer(rb"(?m)^[ \t]*\$(.*)$", data)]
            yield pd.DataFrame(rows, columns=["source", "at", "name"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, length, start, stop, section in zip(b["source"], b["length"], b["start"], b["stop"], b["section"], strict=True):
                with opened(name) as file:
                    _, data = lines_of(file, start, stop, length)
                rows, held = [], section
                for line in data.split(b"\n"):
                    p = line.split()
                    if p and p[0].startswith(b"$"):
                        held = None if p[0].startswith(b"$End") else line.strip()[1:].decode(errors="replace")
                    elif held is not None and p and (row := _gmsh_row(name, held, p)):
                        rows.append(row)
                    if len(rows) == 50_000:
                        yield _mesh_rows(rows)
                        rows = []
                yield _mesh_rows(rows)

    parts = ranges(spark, path, size)
    marks = parts.mapInPandas(headings, "source string, at long, name string")
    before = parts.join(marks, "source").where("at < start").groupBy("source", "start").agg(F.max_by("name", "at").alias("section"))
    parts = parts.join(before, ["source", "start"], "left").withColumn("section", F.when(~F.col("section").startswith("End"), F.col("section")))
    return dealt(parts, "source", "start").mapInPandas(parse, MESH)


def _mesh_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "kind", "id", "x", "y", "z", "cell_type", "conn", "tag"]).astype({"tag": "Int64"})


def vtu_rows(source: str, text: str, scalar: str | None = None) -> list[tuple]:
    """Nodes and cells of a text VTU; pieces follow each other, and tags stay with their own cells."""
    rows, nodes, cells = [], 0, 0
    for piece in ET.fromstring(text).iter("Piece"):
        data = lambda path: (piece.findtext(path) or "").split()  # noqa: E731, B023
        points = [float(v) for v in data("Points/DataArray")]
        arrays = {a.get("Name"): (a.text or "").split() for a in piece.findall("Cells/DataArray")}
        tags = next(([float(v) for v in (a.text or "").split()] for a in piece.findall("CellData/DataArray") if scalar in (None, a.get("Name"))), [])
        for i in range(len(points) // 3):
            rows.append((source, "node", nodes + i, *points[3 * i : 3 * i + 3], None, None, None))
        conn, start = [int(v) for v in arrays.get("connectivity", [])], 0
        for i, (end, kind) in enumerate(zip(map(int, arrays.get("offsets", [])), map(int, arrays.get("types", [])), strict=False)):
            if kind in VTK_TYPES:
                rows.append((source, "cell", cells + i, None, None, None, VTK_TYPES[kind], [nodes + v for v in conn[start:end]], int(tags[i]) if i < len(tags) else None))
            start = end
        nodes, cells = nodes + len(points) // 3, cells + len(arrays.get("offsets", []))
    return rows


def vtu_table(spark: SparkSession, path: str, scalar: str | None = None) -> DataFrame:
    """Nodes and cells of text VTU files as rows of MESH; XML isn't split, so a file is parsed by one task (SRC-11)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                rows = vtu_rows(name, bytes(data).decode(), scalar)
                for s in range(0, len(rows), 50_000):
                    yield _mesh_rows(rows[s : s + 50_000])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, MESH)


def read_mesh(spark: SparkSession, path: str, kind: str, scalar: str | None = None, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(cells, nodes) of Gmsh 2 text (in ranges of `size` bytes) or VTU files, by `source` (SRC-10 to SRC-15)."""
    rows = gmsh_table(spark, path, size) if kind == "gmsh" else vtu_table(spark, path, scalar)
    cells = rows.where("kind = 'cell'").select("source", F.col("id").alias("cell_id"), "cell_type", "conn", F.concat(F.lit("layer_"), F.col("tag").cast("string")).alias("region"))
    return cells, rows.where("kind = 'node'").select("source", F.col("id").alias("node_id"), "x", "y", "z")


def vtk_lines(cells: DataFrame, nodes: DataFrame, active: Column | None = None) -> DataFrame:
    """(n, line) of a legacy text VTK file with a cell scalar phase_active (SNK-02); node ids must run from 0."""
    size, count = F.size("conn") + 1, cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum(F.size("conn") + 1), F.lit(0)).alias("numbers"))
    number = F.create_map(*(F.lit(x) for p in _VTK_NUMBERS.items() for x in p))
    block = 1 << 40
    heads = count.crossJoin(nodes.agg(F.count("*").alias("nodes"))).select(F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("n"), F.concat(F.lit("# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS "), "nodes", F.lit(" double")).alias("line")),
        F.struct(F.lit(2 * block).alias("n"), F.concat(F.lit("CELLS "), "cells", F.lit(" "), "numbers").alias("line")),
        F.struct(F.lit(4 * block).alias("n"), F.concat(F.lit("CELL_TYPES "), "cells").alias("line")),
        F.struct(F.lit(6 * block).alias("n"), F.concat(F.lit("CELL_DATA "), "cells", F.lit("\nSCALARS phase_active int 1\nLOOKUP_TABLE default")).alias("line")),
    )).alias("h")).select("h.*")  # fmt: skip  (one row each)
    points = nodes.select((F.col("node_id") + block).alias("n"), F.concat_ws(" ", *(F.col(k).cast("string") for k in "xyz")).alias("line"))
    conn = cells.select((F.col("cell_id") + 3 * block).alias("n"), F.concat_ws(" ", (size - 1).cast("string"), F.transform("conn", lambda v: v.cast("string"))).alias("line"))
    kinds = cells.select((F.col("cell_id") + 5 * block).alias("n"), number[F.col("cell_type")].cast("string").alias("line"))
    flag = F.when(F.lit(True) if active is None else active, "1").otherwise("0")
    flags = cells.select((F.col("cell_id") + 7 * block).alias("n"), flag.alias("line"))
    out = heads
    for part in (points, conn, kinds, flags):
        out = out.union(part)
    return out


def manifest(results: DataFrame) -> DataFrame:
    """One JSON text per stage: its fields with count, least, greatest and mean (SNK-01, SNK-03)."""
    from ..operators.stages import field_statistics

    return field_statistics(results).groupBy("stage").agg(F.array_sort(F.collect_list(F.struct("field", "n", "low", "high", "mean"))).alias("fields")).select("stage", F.to_json(F.struct("stage", "fields")).alias("json"))


def save_project(tables: dict[str, DataFrame], path: str) -> None:
    """A project's tables as JSON lines, each in a folder of its own under `path` (SNK-04, SNK-12)."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_project(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of `save_project`, by name and schema (SRC-23, SRC-24)."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a heading (SNK-06)."""
    rows.write.mode("overwrite").csv(path, header=True)
