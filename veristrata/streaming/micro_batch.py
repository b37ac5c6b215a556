"""The batch operators over a stream: one micro-batch at a time, first occurrence wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str, time: str, late: str = "1 day") -> StreamingQuery:
    """Rows new within the watermark go through `step` and are appended to path, a folder a batch, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    fresh = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
