"""Streaming forms of the minute flow and of the ingest of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_minute_flow(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Net flow, notional and count per market and minute from a stream of trades (condition_id, ts, D, usdc_amount)."""
    flow = trades.withWatermark("ts", late).groupBy("condition_id", F.window("ts", "1 minute").alias("w"))
    sums = flow.agg(F.sum(F.col("D").cast("double") * F.col("usdc_amount")).alias("net"), F.sum("usdc_amount").alias("usdc"), F.count("*").alias("n"))
    return sums.select("condition_id", F.col("w.start").alias("m"), "net", "usdc", "n")


def ingest_new_files(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, transform=None) -> StreamingQuery:
    """Appends the rows of CSV files that an earlier run hasn't seen; ends when all are read."""
    rows = spark.readStream.schema(schema).option("header", True).csv(source)
    rows = transform(rows) if transform else rows
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
