"""Conversion of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import convert as batch
from ..sources import files


def convert_stream(spark: SparkSession, path: str, target: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Convert new files below path and append rows (doc_id, output_no, name, type, data, error) to
    the Parquet folder out.  Each micro-batch goes through the batch plan; its number names its
    folder, so a batch that is run again after a failure replaces its own rows."""
    def one(rows: DataFrame, number: int) -> None:
        batch.convert(rows, target).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.stream(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
