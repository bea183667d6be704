"""Streams of tags: the time-axis twin of unidirectional clustering, and running counts of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str, value: str) -> DataFrame:
    """Events of a key with gaps under `gap`, closed once the watermark has passed; works on batches and streams alike."""
    return (
        events.withWatermark(time, late)
        .groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def running_counts(tags: DataFrame) -> DataFrame:
    """Counts of positions (seqname, start, strand, sample) as tags arrive; use output mode update or complete."""
    return tags.groupBy("seqname", "start", "strand", "sample").agg(F.count(F.lit(1)).alias("counts"))
