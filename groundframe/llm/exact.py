"""Exact dedup (operator 11): a content sort of normalised texts puts equal ones next to each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import WHITE, cut, named, others

#: Code points of a text that a splitter holds; behind them texts are ordered by their SHA-256, so a splitter stays small.
PREFIX = 32
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text less all ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _marked(batches):
    """Sorted rows (row, sha, norm) → the rows with the number of their run of equal texts in this partition, and whether
    they begin it. A last row holds the partition's first and last text."""
    part, run, head, last = TaskContext.get().partitionId(), -1, None, None
    for b in batches:
        norm, n = b.column("norm"), b.num_rows
        if not n:
            continue
        begins = np.ones(n, bool)
        begins[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if last is None:
            head = norm[0].as_py()
        else:
            begins[0] = norm[0].as_py() != last
        runs = run + np.cumsum(begins)
        none = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("sha"), pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(begins), none, none], names=COLUMNS)
        run, last, kind = int(runs[-1]), norm[n - 1].as_py(), b.column("row").type
    if last is not None:
        ends = [pa.nulls(1, kind), pa.nulls(1, pa.string()), pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.nulls(1, pa.bool_()), pa.array([head]), pa.array([last])]
        yield pa.RecordBatch.from_arrays(ends, names=COLUMNS)


COLUMNS = ["row", "sha", "part", "run", "begins", "head", "tail"]


def _continued(marks: DataFrame) -> DataFrame:
    """Per partition whose first run continues one of earlier partitions: (part, run 0, and that run's gpart, grun).

    The texts of neighbouring partitions are compared by a join; what is ordered in one task has a few numbers a partition.
    """
    by_part = Window.orderBy("part")
    pairs = marks.select("part", "run", F.lag("part").over(by_part).alias("before"))
    heads, tails = marks.select("part", "head"), marks.select(F.col("part").alias("before"), "tail")
    met = pairs.join(heads, "part").join(tails, "before", "left").select("part", "run", F.coalesce(F.col("head") == F.col("tail"), F.lit(False)).alias("same"))
    opens = F.when(~(F.col("same") & (F.col("run") == 0)), F.struct(F.col("part").alias("gpart"), F.col("run").alias("grun")))
    root = F.last(opens, ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn("root", root).where("same").select("part", F.lit(0).cast("long").alias("run"), "root.gpart", "root.grun")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """`docs` with keep_id, group_size, kept and text_sha256: groups of rows whose texts are equal without ASCII white space.

    Of a group, the row with the most code points in its original text, then the smallest id, stays; keep_id is its id,
    and text_sha256 the hash of the group's normalised text. Normalised texts are range-partitioned by splitters that
    Spark samples, and sorted externally within partitions; neighbours are compared in full. Splitters reach through the
    order within a group too, so a group of any size spreads over partitions; the last text of a partition is
    compared with the first one of the next, and runs that go on are counted as one.

    Null and empty or blank texts are equal to each other. Every row counts, repeated ones too: exactly one row of a group
    is kept (of rows that agree in id and length, any one), null ids come last among ties and may be a keep_id. An empty table
    gives an empty one. Columns named as the results, in any case, are replaced; `carry` names the columns that go
    along with the id (all by default; the text too, which then is moved twice).
    """
    (own_id, own_text) = named(id_col, text_col)
    along = others(docs, *RESULTS) if carry is None else named(id_col, *(c for c in carry if c != id_col))
    frame = docs.select(F.struct(*along).alias("row"), own_id.alias("id"), F.coalesce(F.length(own_text), F.lit(0)).alias("n"), normalised(own_text).alias("norm"))
    frame = frame.withColumns({"sha": F.sha2("norm", 256), "prefix": F.substring("norm", 1, PREFIX)})
    best = (F.col("n").desc(), F.col("id").asc_nulls_last())
    spread = frame.repartitionByRange("prefix", "sha", *best).sortWithinPartitions("prefix", "sha", "norm", *best)
    schema = StructType([StructField("row", frame.schema["row"].dataType), *StructType.fromDDL("sha string, part int, run long, begins boolean, head string, tail string")])
    marked = spread.select("row", "sha", "norm").mapInArrow(_marked, schema)
    table = cut(marked)
    rows, marks = table.where("begins is not null").select("row", "sha", "part", "run", "begins"), table.where("begins is null").select("part", "run", "head", "tail")

    first_id = F.max_by(F.col("row")[id_col], "begins").alias("keep")
    runs = rows.groupBy("part", "run").agg(F.count("*").alias("size"), first_id)
    runs = runs.join(_continued(marks), ["part", "run"], "left").withColumn("goes_on", F.col("gpart").isNotNull())
    runs = runs.withColumns({"gpart": F.coalesce("gpart", "part"), "grun": F.coalesce("grun", "run")})
    groups = runs.groupBy("gpart", "grun").agg(F.sum("size").alias("group_size"), F.max_by("keep", ~F.col("goes_on")).alias("keep_id")).where("group_size > 1")
    several = runs.select("part", "run", "gpart", "grun", "goes_on").join(groups, ["gpart", "grun"])
    out = rows.join(several.select("part", "run", "goes_on", "group_size", "keep_id"), ["part", "run"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        *(F.col("row")[f.name].alias(f.name) for f in frame.schema["row"].dataType),
        F.when(alone, F.col("row")[id_col]).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("begins") & ~F.coalesce("goes_on", F.lit(False))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
