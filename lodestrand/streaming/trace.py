"""Append-only event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.shared import shared_dir


def hourly_counts(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Read a folder of Parquet files as a stream, count events by hour and type, and return the counts of all hours.

    Each batch appends the counts that it changed, under its number; of an hour and type the last one holds, so hours
    that the watermark hasn't passed yet are there as well.
    """
    events = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").parquet(folder)
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    at = shared_dir(spark)
    rows = counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n_events")


    def store(batch: DataFrame, number: int) -> None:  # writing a batch again replaces it
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = rows.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(store).start()
    query.awaitTermination()
    said = spark.read.schema(f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(f"{at}/out")
    return said.groupBy("hour", "event_type").agg(F.max_by("n_events", "batch").alias("n_events"))
