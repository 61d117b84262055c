"""The folder that driver and executors share: ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As Spark resolves it, with its scheme. Where none is named, a local master (one machine) gets one in its warehouse;
    a cluster is an error, for the driver's disk is not the executors'."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docketry-shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    at = context._jvm.org.apache.hadoop.fs.Path(found)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
