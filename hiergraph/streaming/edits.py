"""Edit events as a stream: micro-batches with exactly one file set each, so a replayed batch overwrites what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream with ts as TIMESTAMP and a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def apply_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each micro-batch below ``path`` under its batch id until the source is drained."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(stream: DataFrame, path: str, checkpoint: str, width: str = "1 day") -> None:
    """Events by window and type, each batch's changed counts below its batch id; the newest batch of a window has its count.

    The stream's watermark bounds the state: windows that lie behind it are given up."""
    counts = stream.groupBy(F.window("ts", width).alias("w"), "event_type").count().select(F.col("w.start").alias("start"), "event_type", F.col("count").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish(edits: DataFrame, path: str) -> None:
    """Append edit messages (operation_id, payload columns) as JSON lines, one message a line: what a queue would carry."""
    edits.select("operation_id", F.to_json(F.struct("*")).alias("value")).write.mode("append").json(path)


def consume(spark: SparkSession, path: str, payload: str, out: str, checkpoint: str) -> None:
    """Read published messages as a stream, each operation once, and append what they say; a restart goes on behind the last message."""
    lines = spark.readStream.schema("operation_id long, value string").json(path)
    said = lines.dropDuplicates(["operation_id"]).select("operation_id", F.from_json("value", payload).alias("m")).select("m.*")
    said.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
