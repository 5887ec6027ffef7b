"""Streaming versions of stage and monitoring queries: extensions, each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(readings: DataFrame, *, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Per window and kind of reading (ts, kind, value): count, mean, extremes. Works on streams and tables alike."""
    r = readings.withWatermark("ts", late) if readings.isStreaming else readings
    out = r.groupBy(F.window("ts", width, slide or width), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kind", "n", "mean", "low", "high")


def sessions(readings: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Per region: sessions of readings (ts, region) no further apart than `gap`."""
    r = readings.withWatermark("ts", late) if readings.isStreaming else readings
    out = r.groupBy(F.session_window("ts", gap), "region").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "region", "n")


def first_seen(rows: DataFrame, keys: list[str], *, late: str = "2 hours") -> DataFrame:
    """Rows less those whose keys came before; on a stream, within the watermark of `ts`."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def activation_stream(actions: DataFrame) -> DataFrame:
    """The stage fold over a stream of (region long, seq long, active boolean or null): each row with is_active.

    The state is a region's last stated value; within a batch rows go by seq (compare operators.stages.activation).
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values("seq")
        stated = rows["active"].astype("boolean").ffill().fillna(now).astype(bool)
        state.update((bool(stated.iloc[-1]),))
        yield pd.DataFrame({"region": rows["region"], "seq": rows["seq"], "is_active": stated})

    return actions.groupBy("region").applyInPandasWithState(fold, "region long, seq long, is_active boolean", "active boolean", "append", "NoTimeout")
