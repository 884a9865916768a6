"""Streaming ingest: deduplicated appends and a live count kept by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.events import new_rows


def deduplicated(stream: DataFrame, event_time: str, key: str = "iuid", delay: str = "1 hour") -> DataFrame:
    """The stream with each key once within the watermark; event_time is a TIMESTAMP."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, table: str, log: str, key: str = "iuid") -> StreamingQuery:
    """Append to the parquet folder `table` the rows whose key it doesn't hold yet, one micro-batch at a time, until the source is drained.

    The key set is read anew for each batch, so a restarted query adds nothing twice.
    """
    schema = stream.schema

    def step(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema(schema).parquet(table)
        new_rows(batch, known, key).select(*schema.names).write.mode("append").parquet(table)

    stream.sparkSession.createDataFrame([], schema).write.mode("append").parquet(table)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", log).trigger(availableNow=True).start()
