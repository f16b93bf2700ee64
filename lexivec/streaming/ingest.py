"""Structured Streaming: bounded intake, late and repeated deliveries, running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexivec.operators import acquire, records


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_within(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """The first delivery of each key; state is kept only as long as deliveries may be late."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def arrivals_per_window(stream: DataFrame, event_time: str, by: str, delay: str, size: str) -> DataFrame:
    """Rows and rows delivered late of each window and group; windows close ``delay`` after their end."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, size).alias("w"), by)
        .agg(F.count("*").alias("n"), F.count_if(F.col("ingested_at") > F.col(event_time) + F.expr("interval 1 day")).alias("late"))
        .select(F.col("w.start").alias("start"), by, "n", "late")
    )


def append_unseen(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append records whose id the table does not hold yet.

    Each micro-batch is anti-joined with the table and reduced to the first delivery of an id; the batch number
    names its folder, so a repeated batch replaces what it wrote.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = records.first_per_key(batch.where("qid is not null"), "qid", F.col("ingested_at"), F.col("record_id"))
        try:
            known = spark.read.parquet(out).where(F.col("epoch") != epoch)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            fresh = acquire.unseen(fresh, known)
        fresh.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("epoch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def worker_counters(stream: DataFrame) -> DataFrame:
    """Running batches, items and peaks of each worker, for update mode."""
    return stream.groupBy("worker_id").agg(
        F.count("*").alias("batches"), F.sum("items").alias("items"), F.max("max_allocated_bytes").alias("max_allocated_bytes")
    )
