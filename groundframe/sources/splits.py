"""Files read in ranges of bytes: Spark plans the ranges as rows, and each task reads its own, so no task and no driver holds a file."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Rounds

#: Bytes of a range.
SIZE = 16 << 20
#: Bytes that a task reads at least, in as many ranges as that takes, once every core has some.
TASK = 16 << 20


def opened(path: str):
    """A file by the path that Spark gives it, for reading at any place."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(name)


def taken(file, start: int, stop: int) -> bytes:
    file.seek(start)
    return file.read(max(0, stop - start))


def ranges(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """(source, length, start, stop) of ranges of the files under `path` (one or a folder, with marks as Spark reads them), for tasks to read.

    Only names and lengths are listed. Ranges are dealt out evenly (see `dealt`).
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "length").where("length > 0")
    parts = files.select("source", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    parts = parts.withColumn("stop", F.least(F.col("start") + size, "length"))
    return dealt(parts)


def dealt(parts: DataFrame, *keys: str) -> DataFrame:
    """Ranges dealt over tasks, one each while there are cores for that; then each task has ranges of TASK bytes together, so that short ranges of
    large files don't make a task, and a task's report to the driver, of their own."""
    n, total = parts.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    return parts.repartition(max(1, min(n, max(parts.sparkSession.sparkContext.defaultParallelism, -(-total // TASK)))), *keys)


def lines_of(file, start: int, stop: int, length: int, step: int = 1 << 16) -> tuple[int, bytes]:
    """(place, bytes) of the whole lines that begin in [start, stop)."""
    lo = max(0, start - 1)
    data = taken(file, lo, stop)
    if start > 0:
        skip = data.find(b"\n")
        if skip < 0 or lo + skip + 1 >= stop:  # no line begins here
            return stop, b""
        data, lo = data[skip + 1 :], lo + skip + 1
    hi = stop
    while hi < length and not data.endswith(b"\n"):
        more = taken(file, hi, min(length, hi + step))
        cut = more.find(b"\n")
        data += more if cut < 0 else more[: cut + 1]
        hi = length if cut >= 0 else hi + step
    return lo, data


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if ":/" in path:
        raise ValueError(f"{path}: a single file is written in place, which only a mounted file system can do")
    return path


def write_file(lines: DataFrame, path: str, size: int = SIZE) -> None:
    """(n, line) as one text file in order of n, on a file system that all executors mount (SNK-02, SNK-05).

    Spark first writes sorted parts to the shared folder. As the lengths of all parts are then known, so is the place of each in the file,
    and tasks copy ranges of parts to their places, side by side: nothing goes through the driver or one task, and a task that is repeated
    writes the same bytes again. The file has its name only when it is whole. An existing file is an error.
    """
    spark, target = lines.sparkSession, _local(path)
    if os.path.exists(target):
        raise FileExistsError(target)
    rounds = Rounds(spark)
    parts = rounds.written(lines.repartitionByRange("n").sortWithinPartitions("n").select("line").write.text)
    name = F.element_at(F.split("source", "/"), -1)
    files = spark.read.format("binaryFile").load(parts).select(F.col("path").alias("source"), "length").where("length > 0")
    w = Window.orderBy(F.length(name), name).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    places = files.select("source", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("place"))
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    unfinished = f"{target}.{uuid.uuid4().hex}"
    with open(unfinished, "wb") as f:
        f.truncate(total)

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, start, stop, place in zip(b["source"], b["start"], b["stop"], b["place"], strict=True):
                with opened(source) as part, open(unfinished, "r+b") as f:
                    f.seek(place + start)
                    f.write(taken(part, start, stop))
            yield pd.DataFrame({"n": (b["stop"] - b["start"]).astype("int64")})

    if total:
        todo = ranges(spark, parts, size).join(places, "source")
        copied = dealt(todo).mapInPandas(copy, "n long").agg(F.sum("n")).first()[0]
        if copied != total:
            raise OSError(f"{copied} of {total} bytes were copied to {unfinished}")
    os.replace(unfinished, target)
    rounds.drop_before(0)
