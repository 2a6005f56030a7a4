"""Incremental ingest. The portal imports in batches; as a stream, each micro-batch is one import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from curatorium.operators import relations, search


def upsert_stream(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str) -> DataStreamWriter:
    """A writer that upserts each micro-batch into versions of a Parquet table: the batch's latest row of each key wins over the stored one.

    Version n + 1 is written beside version n, so a batch that is run again writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = search.first_per(batch, keys, F.col(order).desc())
        if number:
            current = spark.read.parquet(f"{table}/v={number - 1}")
            latest = relations.upserted(current, latest.select(*current.columns), keys).drop("action")
        latest.write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the delay; later copies are dropped and old keys forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
