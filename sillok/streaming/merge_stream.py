"""Postings arriving as a stream, merged batch by batch; the merge is idempotent, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sillok.operators.merge import observed


def keep_observations(stream: DataFrame, path: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Append each distinct observation (address, source, time) of a stream of postings once; ``collected`` is its event time, later ones than ``late`` are dropped by the watermark."""
    rows = observed(stream).withWatermark("collected", late).dropDuplicatesWithinWatermark(["url", "source_id", "collected_at"])
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
