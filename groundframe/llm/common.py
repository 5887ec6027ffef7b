"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: \x20\x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
#: Whether the shuffle files of an execution go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, outlives executors.

    Spark is told to drop the shuffle files of this write at its end: nothing reads them later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` made and nothing will read again."""
    spark = df.sparkSession
    base = shared_dir(spark).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def named(*names: str) -> list[Column]:
    """Columns by their exact names, which may hold dots and other marks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def others(df: DataFrame, *made: str) -> list[Column]:
    """The columns of `df` less those named in `made` (Spark compares without regard to case)."""
    gone = {m.lower() for m in made}
    return named(*(c for c in df.columns if c.lower() not in gone))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of `df` has (Spark compares without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers, so that near inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b long): (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps: every step moves links to smaller ends and keeps
    their number linear, so a hub never multiplies rows. Each step is one grouped minimum (combined
    before the shuffle) and one join whose hot keys adaptive execution splits. Nulls are ignored.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, now = now, cut(small.where("u <> v").distinct())
        last, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(before)
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def odd_ids(df: DataFrame, id_col: str) -> bool:
    """Whether an id is null or repeated, by a count over ids alone."""
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    return not ids.groupBy("i").count().where("count > 1 or i is null").limit(1).isEmpty()


def unique_key(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """`df` with `key`: a non-null long, the same for rows that agree in id and text, and ordered like the ids.

    The id itself where ids are unique and not null (found by a count over ids alone). Otherwise ids are ranked
    with their texts' hashes (null ids last) by a global sort and numbered through.
    """
    if not odd_ids(df, id_col):
        return df.withColumn(key, F.col(id_col).cast("long"))
    tag, i, t = fresh(df, "key_tag", "key_i", "key_t")
    both = df.select(F.col(id_col).cast("long").alias(i), F.xxhash64(text_col).alias(t)).distinct()
    ranked = cut(both.repartitionByRange(F.col(i).asc_nulls_last(), F.col(t)).sortWithinPartitions(F.col(i).asc_nulls_last(), t).withColumn(key, F.monotonically_increasing_id()))
    out = df.withColumn(tag, F.xxhash64(text_col)).join(ranked, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(tag) == F.col(t)))
    return out.drop(tag, i, t)
