"""Streams of documents: per-document extraction as they arrive, upserts, and windowed volume with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators import numeric_fields
from docketry.operators.normalize import gate_asset_cost, gate_horse_power


def token_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def extract_batch(tokens: DataFrame) -> DataFrame:
    """Gated horse power and cost of each document of one micro-batch; a document's tokens arrive together."""
    found = numeric_fields.best_fields(tokens)
    gated = lambda f, gate: F.when(F.col(f"{f}.source") != "none", gate(F.col(f"{f}.value"), F.col(f"{f}.confidence"))).alias(f)
    return found.select("doc_id", gated("horse_power", gate_horse_power), gated("asset_cost", gate_asset_cost))


def run_extraction(tokens: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch under its own number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        extract_batch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return tokens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_volume(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day by type; a day closes when the watermark has passed it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")
