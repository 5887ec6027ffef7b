"""Queries of models on tables with ids of any size."""

from pyspark.sql import functions as F

from groundframe import plans
from groundframe.plans.views import cells

from .oracle import compare


def test_sums_of_node_numbers_beyond_64_bits(spark, sf, tmp_path):
    """The sum of products of 60 times the tables stopped with an overflow."""
    events = spark.read.parquet(f"{sf}/events.parquet").limit(400)
    events.withColumn("event_id", F.col("event_id") + 10**14).write.parquet(f"{tmp_path}/events.parquet")
    kinds = {(r["region"], tuple(r["conn"])) for r in cells(spark, str(tmp_path)).collect()}
    got = {r["phase"]: r for r in plans.QUERIES["model_compact"](spark, str(tmp_path)).collect()}
    for phase in range(4, 9):
        nodes = sorted({n for region, conn in kinds if len(region) <= phase for n in conn})
        assert not nodes or (got[phase]["n"], got[phase]["product"]) == (len(nodes), sum(k * n for k, n in enumerate(nodes)))
    assert max(r["product"] for r in got.values()) > 1 << 63
    same, want = compare(spark, sf, plans.QUERIES["model_compact"], plans.SQL["model_compact"])
    assert same == want and dict(plans.QUERIES["model_compact"](spark, sf).dtypes)["product"] == "bigint"
