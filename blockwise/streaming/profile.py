"""Streaming profile: windowed feature statistics over an event stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(events: DataFrame, ts: str = "ts", group: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, group, n, n_missing, mean, variance) per tumbling window; works on batch and streaming frames."""
    stream = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    v = F.col(value)
    out = stream.groupBy(F.window("_ts", window).alias("w"), F.col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v.isNull().cast("bigint")).alias("n_missing"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance")
    )
    return out.select(F.col("w.start").alias("start"), group, "n", "n_missing", "mean", "variance")
