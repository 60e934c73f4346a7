"""Incremental zone_trips preparation with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from odflow.operators.locate import cell_index
from odflow.plans.prepare import zone_trips


def zone_trips_stream(spark: SparkSession, source_path: str, schema: StructType | str,
                      layer: DataFrame, sink_path: str, checkpoint_path: str,
                      keep: Sequence[str] | None = None, fmt: str = "parquet",
                      available_now: bool = True, **cols) -> StreamingQuery:
    """Locate both ends of newly arrived trip records and append them to ``sink_path``.

    ``checkpoint_path`` must be on shared storage (the stream's progress and the file sink
    log live there, so a restarted driver resumes exactly once).  The layer's index is
    written once up front and probed by every micro-batch.
    """
    index = cell_index(layer, carry=["cx", "cy"])
    src = spark.readStream.schema(schema).format(fmt).load(source_path)
    out = zone_trips(src, layer, keep=keep, index=index, **cols)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(sink_path)
