"""Rule-based checks: every rule is a query for violations, and a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, code: str, *, severity: str = "error", target: str | None = None) -> DataFrame:
    """Issues for rows of `child` whose non-null key no parent has (VAL-01, JOIN-16, JOIN-17)."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    found = child.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti")
    return _issues(found, severity, code, F.col(target or key))


def violations(rows: DataFrame, rule: Column, code: str, target: str, *, severity: str = "error") -> DataFrame:
    """Issues for rows that a rule doesn't hold for; null doesn't hold."""
    return _issues(rows.where(~F.coalesce(rule, F.lit(False))), severity, code, F.col(target))


def _issues(rows: DataFrame, severity: str, code: str, target: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), target.cast("string").alias("target"))


def report(*issues: DataFrame) -> DataFrame:
    """Issues counted by severity and code (VAL-01, SRT-04)."""
    return reduce(DataFrame.union, issues).groupBy("severity", "code").agg(F.count("*").alias("issues"), F.min("target").alias("first"))


def gate(report_rows: DataFrame) -> DataFrame:
    """One row: blocked with any error, warn with any warning, else ready (VAL-03, AGG-33)."""
    n = report_rows.agg(F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("issues"))), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("issues"))), F.lit(0)).alias("warnings"))
    return n.withColumn("status", F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "warn").otherwise("ready"))
