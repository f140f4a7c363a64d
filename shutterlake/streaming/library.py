"""Streams of a photo library: ingest of listings, event sessions, and assignment to the nearest centroid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import rescan
from ..operators.vectors import best_prototype


def session_albums(photos: DataFrame, by: list[str], date: str, gap: str = "6 hours", late: str = "1 day", least: int = 5) -> DataFrame:
    """Event albums of a stream. Photos later than the watermark are dropped and open sessions come out when it passes them;
    the batch operator over all photos is the correction for both."""
    timed = photos.where(F.col(date).isNotNull()).withColumn("_at", F.col(date).cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(*by, F.session_window("_at", gap).alias("w")).agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("w")


def ingest(listings: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, path: str = "path", size: str = "size") -> StreamingQuery:
    """Classifies each batch of a stream of file listings against the known files and hands it to an idempotent sink."""

    def batch(df: DataFrame, number: int) -> None:
        sink(rescan(known(), df.dropDuplicates([path]), path, size), number)

    return listings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assign(faces: DataFrame, prototypes: DataFrame, least: float = 0.4) -> DataFrame:
    """The nearest prototype of each face of a stream; a face below the threshold has none and is left to the batch pass."""
    return best_prototype(faces, prototypes, "id", "embedding", "cluster_id", "centroid", least)
