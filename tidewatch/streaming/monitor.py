"""Streaming drift monitor: watermarked category counts per entity and bucket, scored by a fitted detector.

An extension beyond the batch operators: counts are a Structured Streaming aggregate, and every closed bucket is scored
with the reference of a fitted CatDrift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..operators.drift import METRICS, CatDrift


def bucket_counts(stream: DataFrame, id_col: str, time_col: str, target_col: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """id, bucket, x, n over tumbling windows; rows later than ``late`` are dropped by the watermark."""
    rows = stream.select(F.col(id_col).alias("id"), F.col(time_col).cast("timestamp").alias("t"), F.col(target_col).alias("x")).filter("id is not null and x is not null")
    counts = rows.withWatermark("t", late).groupBy("id", F.window("t", width).alias("w"), "x").agg(F.count("*").alias("n"))
    return counts.select("id", F.col("w.start").alias("bucket"), "x", "n")


def score_counts(counts: DataFrame, detector: CatDrift) -> DataFrame:
    """id, bucket, metric, drift of finished buckets (a batch of counts) against the detector's reference."""
    buckets = counts.select("id", "bucket").distinct()
    grid = buckets.join(detector.reference, "id").join(counts, ["id", "bucket", "x"], "left")
    total = counts.groupBy("id", "bucket").agg(F.sum("n").alias("t"))
    rows = grid.join(total, ["id", "bucket"]).withColumn("p", ratio(F.coalesce("n", F.lit(0)), F.col("t")))
    if detector.func == "jensenshannon":
        g = W.partitionBy("id", "bucket")
        rows = rows.withColumn("p", ratio(F.col("p"), F.sum("p").over(g))).withColumn("q", ratio(F.col("q"), F.sum("q").over(g)))
    scored = rows.groupBy("id", "bucket").agg(METRICS[detector.func](F.col("p"), F.col("q")).alias("metric"))
    return scored.join(detector.threshold_frame, "id", "left").select("id", "bucket", "metric", F.coalesce(F.col("metric") >= F.col("threshold"), F.lit(False)).alias("drift"))


def start(stream: DataFrame, detector: CatDrift, sink, id_col: str, time_col: str, target_col: str, checkpoint: str, width: str = "1 day", late: str = "1 day", **trigger):
    """Start the monitor; ``sink(df, epoch)`` receives each epoch's scored buckets (append mode)."""
    counts = bucket_counts(stream, id_col, time_col, target_col, width, late)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).foreachBatch(lambda df, epoch: sink(score_counts(df, detector), epoch)).start()
