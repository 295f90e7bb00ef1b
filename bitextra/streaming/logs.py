"""Streaming queries over logs and arriving pages, and a runner for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextra.operators.leaks import scan_glue, scan_leaks
from bitextra.session import scratch_path
from bitextra.sources.pagetext import page_lines, read_page_text


def stream_daily_counts(stream: DataFrame, delay: str = "1 day", by=("status",)) -> DataFrame:
    """Entries per UTC day and status: the daily rotation as a tumbling window."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("log_date"), *by, "n")
    )


def dedup_transitions(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """One entry per job and status within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "status"])


def retain_days(stream: DataFrame, days: int = 30, day_of: str = "ts") -> DataFrame:
    """Daily state that leaves memory once the watermark is ``days`` past it."""
    return stream_daily_counts(stream.withColumn("ts", F.col(day_of)), f"{days} days", by=())


def stream_scan(spark: SparkSession, path: str) -> DataFrame:
    """Leaks and glued words of pages as they arrive (T7); stateless.

    Returns a streaming frame: pdf, page, block, line, kind, reason, detail.
    """
    lines = page_lines(read_page_text(spark, path, streaming=True))
    keys = ["pdf", "page", "block", "line"]
    leaks = scan_leaks(lines.select(*keys, "text")).select(
        *keys, F.lit("leak").alias("kind"), "reason", F.col("fragment").alias("detail")
    )
    glue = scan_glue(lines.select(*keys, "text")).select(
        *keys, F.lit("glue").alias("kind"), "reason", F.col("token").alias("detail")
    )
    return leaks.unionByName(glue)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all available input and read its sink back.

    The sink and the checkpoint live in the shared folder, so a lost executor
    or a restarted query resumes from there. In update mode every micro-batch
    is stored with its number; the caller keeps the last row of each key.
    """
    spark = stream.sparkSession
    sink, state = scratch_path(spark, "sink"), scratch_path(spark, "state")
    writer = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", state)
        .trigger(availableNow=True)
    )
    if mode == "append":
        query = writer.format("parquet").option("path", sink).start()
    else:
        def store(batch: DataFrame, number: int) -> None:
            # Rewriting a repeated batch's own folder keeps the sink idempotent.
            batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

        query = writer.foreachBatch(store).start()
    query.awaitTermination()
    fields = list(stream.schema.fields)
    if mode != "append":
        fields.append(T.StructField("batch", T.IntegerType()))
    return spark.read.schema(T.StructType(fields)).parquet(sink)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last stored row of every key of an update-mode sink."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return (
        updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        .select(*keys, "_r.*")
    )
