"""Chunks of a stream that are recorded exactly once, also if a run is stopped and resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def record(stream: DataFrame, path: str, state: str) -> StreamingQuery:
    """Write each micro-batch to its own folder below `path`; a batch that is run again replaces its folder.
    Reading `path` gives every chunk once. The query stops when its source holds no more."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/chunk={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
