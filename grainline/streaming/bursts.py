"""Bursts over a stream of frames: an extension, not part of the batch semantics.

Frames closer than the gap share a session; late frames up to the watermark are merged in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bursts(frames: DataFrame, gap: str = "2 seconds", late: str = "1 minute", by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    d = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # sessions of a stream need a key besides; frames without time belong to none
    own = [by] if by else [F.col("ts").isNull().alias("_untimed")]
    return d.groupBy(*own, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames")).select(*keys, "w.start", "w.end", "frames")
