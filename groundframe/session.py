"""Spark session defaults shared by tests, benchmarks and the entry module."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a task has where each becomes many.
ROWS = 20_000


def get_spark(app: str = "groundframe", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC as time zone; `conf` overrides any setting."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int = ROWS) -> int:
    """Tasks that `df` fills with about `rows` of its rows each: to deal out what is made of them in numbers that follow the input, not the session's settings."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """A table's rows dealt by ranges of `key` over tasks of about `rows` each.

    A small file is read by one task, whatever is then made of its rows; ranges keep neighbours together. The count is that of the files' footers.
    """
    parts = tasks_for(df, rows)
    return df.repartitionByRange(parts, key) if parts > 1 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Rounds:
    """Tables of an iteration, written to the shared folder: each cuts lineage and outlives executors, and goes once a later one stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}", []

    def written(self, writer) -> str:
        """The path of a new table, which `writer` has been given."""
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        writer(self.paths[-1])
        return self.paths[-1]

    def write(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.written(df.write.parquet))

    def drop(self, path: str) -> None:
        """Deletes a table, or a part of one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_before(self, keep: int = 1) -> None:
        """Deletes all tables but the last `keep`."""
        old = self.paths[: len(self.paths) - keep]
        for p in filter(None, old):
            self.drop(p)
        self.paths[: len(old)] = [None] * len(old)
