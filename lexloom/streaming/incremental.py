"""Incremental counterparts: only new files, only new ids, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def landed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the lines of answer files as they land; each file is read once."""
    return spark.readStream.text(folder)


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append rows whose key is not stored yet, micro-batch by micro-batch, and stop when all is read.

    The keys of each batch are compared with the stored ones by an anti-join, so a batch that is
    replayed after a failure adds nothing twice and no state grows in memory.
    """

    def write(batch: DataFrame, _: int) -> None:
        from ..sources.files import exists

        spark = batch.sparkSession
        fresh = batch.where(f"{key} is not null").dropDuplicates([key])
        if exists(spark, path):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(batch.columns)
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def skip_seen(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not stored."""
    return batch.join(stored.select(key).where(f"{key} is not null").distinct(), key, "left_anti")
