"""The same running state as a stream, and the stream of a folder of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import state


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Events of a Parquet folder or file glob as a stream, ts as an instant."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def history_stream(events: DataFrame, key: str) -> DataFrame:
    """Running first, last and count of each key; write it in complete or update mode."""
    return state.history(events, key)


def windowed_counts(events: DataFrame, key: str, *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each window and key; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def run_to_memory(stream: DataFrame, spark: SparkSession, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now and returns its last result. For results of bounded size (tests, reports)."""
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def run_to_table(stream: DataFrame, spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Runs a stream in update mode over what there is now; each batch is written to the folder, and the latest state of
    each key is read back from all of them. Nothing passes through the driver."""
    where = f"{folder}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/state/{number:010d}")

    q = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{where}/state/*")
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(key, *[F.col(f"s.{c}") for c in others])
