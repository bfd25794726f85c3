"""Structured Streaming over event files: an addition, as the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with event time as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_table_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The stream of a table that is one Parquet file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = spark.read.parquet(path.toString()).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path.toString()) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """What an aggregating stream leaves in path once it has read everything there is; a batch's whole result takes the place of the one before."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/result")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/result")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum by window and type; rows later than the watermark are left out. Works on batches alike."""
    w = F.window("ts", width)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def latest_per_user(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each user's latest event so far."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last")).select("user_id", "last.ts", "last.event_id", "last.event_type")
