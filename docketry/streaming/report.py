"""An accuracy report that grows with the documents that are scored.

Each micro-batch writes, under its own number, the counts so far (those of the batch before it and its own: one row) and
its own latencies (counted by value). The report after a batch is made of these alone, and a batch that runs again
writes the same once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators import evaluate


def add_batch(scored: DataFrame, number: int, target: str) -> None:
    """Counts of ``scored`` (``evaluate.score_documents``) on top of those of the batches before ``number``."""
    spark = scored.sparkSession
    own = evaluate.report_sums(scored)
    before = _batches(spark, f"{target}/sums", own.schema.simpleString()[7:-1].replace(":", " "))
    last = before.where(F.col("batch") < number).agg(F.max("batch")).first()[0] if before is not None else None
    if last is not None:
        both = own.unionByName(before.where(F.col("batch") == last).drop("batch"))
        own = both.agg(*(F.sum(c).alias(c) for c in own.columns))
    own.coalesce(1).write.mode("overwrite").parquet(f"{target}/sums/batch={number}")
    scored.groupBy(F.col("seconds").cast("double").alias("v")).agg(F.count("*").alias("c")).where("v is not null").write.mode("overwrite").parquet(f"{target}/seconds/batch={number}")


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def report_after(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """``evaluate.report`` of all documents up to batch ``number``, the last one without it; no row before the first batch."""
    sums = spark.read.parquet(f"{target}/sums").withColumn("batch", F.col("batch").cast("long"))
    asked = sums.where(F.lit(True) if number is None else F.col("batch") <= number)
    last = asked.agg(F.max("batch")).first()[0]
    counts = spark.read.schema("v double, c long, batch long").parquet(f"{target}/seconds").where(F.col("batch") <= F.lit(last)).groupBy("v").agg(F.sum("c").alias("c"))
    return evaluate.report_of(asked.where(F.col("batch") == F.lit(last)).drop("batch"), evaluate.latency_of(counts))


def run_report(results: DataFrame, labels: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Score the flat results (``assemble.legacy``) of each micro-batch that have a label, and add them to the report."""

    def write(batch: DataFrame, number: int) -> None:
        mine = labels.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        add_batch(evaluate.score_documents(mine, batch), number, target)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
