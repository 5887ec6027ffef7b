from pyspark.sql import functions as F

from groundframe import streaming
from groundframe.operators.stages import activation


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def readings(spark, sf, stream):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    src = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parq*") if stream else batch
    return src.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value", F.col("user_id").alias("region"), "event_id")


def test_windows_equal_the_batch(spark, sf):
    got = run(streaming.windowed(readings(spark, sf, True)), "windows", "complete").collect()
    want = streaming.windowed(readings(spark, sf, False)).collect()
    key = lambda rows: sorted((r["start"], r["kind"], r["n"], round(r["mean"], 6)) for r in rows)
    assert key(got) == key(want) and got


def test_fold_equals_the_batch(spark, sf):
    def actions(stream):
        r = readings(spark, sf, stream)
        return r.select("region", F.col("event_id").alias("seq"), F.when(F.col("kind") == "signup", True).when(F.col("kind") == "error", False).alias("active"))

    got = {(r["region"], r["seq"]): r["is_active"] for r in run(streaming.activation_stream(actions(True)), "fold").collect()}
    assert got == {(r["region"], r["seq"]): r["is_active"] for r in activation(actions(False)).collect()}


def test_first_seen_and_sessions(spark, sf):
    assert run(streaming.first_seen(readings(spark, sf, True), ["event_id"]), "first").count() == readings(spark, sf, False).count()
    s = streaming.sessions(readings(spark, sf, False)).agg(F.sum("n")).first()[0]
    assert s == readings(spark, sf, False).count()
