"""Rows of an attribute that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a stream of (id, value) to Parquet files under `path`, one folder a batch, so that a batch that is run
    again after a failure replaces itself. What is there is an attribute table: read it by `appended`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("id is not null").select("id", "value").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def appended(spark, path: str) -> DataFrame:
    """(id, value): of several rows of an id, the one of the latest batch (there, the greatest value)."""
    rows = spark.read.parquet(path)
    latest = F.max(F.struct("batch", "value"))
    return rows.groupBy("id").agg(latest.alias("l")).select("id", "l.value")
