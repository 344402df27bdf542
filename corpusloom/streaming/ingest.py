"""Incremental ingest: the pool's row-wise steps on a stream (an addition to the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import normalize, usable
from corpusloom.functions.wellformed import well_formed


def ingested(stream: DataFrame, text: str = "raw", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Normalised, usable, well-formed commands of a stream, the first of equals within the watermark's delay.

    State is one key per distinct command of the last ``delay``; later copies are left
    to the batch dedup of the pool.
    """
    rows = stream.withColumn("raw", F.col(text)).withColumn("command", normalize(F.col("raw"))).where(usable(F.col("command")))
    rows = well_formed(rows).where("size(violations) = 0").drop("violations")
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["command"])


def write_pool(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream's commands to a table; file sinks commit each batch once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
