"""Deduplication of a stream of reads.

A molecule's reads come close together in time.  Readings are counted in event
time windows by barcode and UMI; when the watermark passes a window, its counts
are final and go through the unique-mode rule in each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import unique_mode


def counted_readings(stream: DataFrame, time: str, keys: list[str], signature: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of readings per window, each emitted once (append mode)."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.window(time, window), *keys, *signature).agg(F.count("*").alias("n"))


def molecules_to(counted: DataFrame, keys: list[str], signature: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the stream; sink gets each batch's molecules: window, keys, signature, n.

    A window is closed by one batch, so a batch holds all its readings.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        sink(unique_mode(df, ["window", *keys], signature), epoch)

    return counted.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).start()
