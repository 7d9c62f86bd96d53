"""The pileup as a stream: reads arrive in order of position, and a place is final once all samples have passed it.

Position plays the part of event time. Folded statistics are additive, so that the stream's result equals the batch fold's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators import pileup

#: Positions are seconds from here.
EPOCH = "1970-01-01 00:00:00"


def position_time(pos) -> "F.Column":
    return F.timestamp_seconds(pos.cast("long"))


def stream_reads(spark, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def fold_stream(reads: DataFrame, keys: list[str], pos: str = "pos", lateness: int = 1000) -> DataFrame:
    """The seven statistics of each group, given out once no read this close behind the furthest can come any more.

    keys must include pos. Reads that come later than that are dropped by the watermark; check order first where they are an error.
    """
    timed = reads.withColumn("_at", position_time(F.col(pos))).withWatermark("_at", f"{lateness} seconds")
    return pileup.fold(timed, [*keys, "_at"], pos=pos).drop("_at")


def sessions(spans: DataFrame, keys: list[str], start: str, end: str, lateness: int = 10_000) -> DataFrame:
    """(keys, start, end, members): runs of spans that touch or overlap, as session windows whose gap is the span's own length."""
    gap = (F.col(end) - F.col(start) + 1).cast("string")
    timed = spans.withColumn("_at", position_time(F.col(start))).withWatermark("_at", f"{lateness} seconds")
    window = F.session_window("_at", F.concat(gap, F.lit(" seconds")))
    return timed.groupBy(*keys, window.alias("_w")).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_w")
