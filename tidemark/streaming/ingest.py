"""Streams into dated datasets: each micro-batch is one publication. An extension; late data is a later version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.specs import DatasetSpec


def stream_into(lake, spec: DatasetSpec, stream: DataFrame, checkpoint: str, *, ingested_at: datetime | None = None, available_now: bool = True) -> StreamingQuery:
    """Publish a stream's micro-batches. A batch that is run again commits nothing, as its content is unchanged.

    Rows of one batch that contradict each other are refused, like those of one provider response.
    """

    def publish(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            lake.raw.ingest(spec, batch, ingested_at=ingested_at, run_id=f"stream-{spec.name}-{number}")

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
