"""Readers: documents as files, master data, labels, caches and label rows; missing or broken input is data, not an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.sources.images import file_system
from docketry.sources.shared import kept

EXTENSIONS = ("pdf", "png", "jpg", "jpeg")
HASH_DIGITS = 16


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*EXTENSIONS)


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, content and hash of the files of a folder; Spark lists no file without bytes."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", "content", content_hash(F.col("content")).alias("hash"))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """``all_files`` of the supported kinds, in the order of their paths."""
    return all_files(spark, folder).where(supported(F.col("path"))).orderBy("path")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, HASH_DIGITS)


def checked(paths: DataFrame, known: DataFrame) -> DataFrame:
    """``paths`` (path) with ``error``: unsupported_format, corrupt_input (not among ``known`` paths) or null."""
    ok = supported(F.col("path"))
    found = paths.join(known.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left")
    return found.withColumn("error", F.when(~ok, "unsupported_format").when(F.col("seen").isNull(), "corrupt_input")).drop("seen")


def _entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    return rows.select(F.posexplode("entries").alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), "e.*")


def dealer_master(spark: SparkSession, path: str) -> DataFrame:
    """seq, canonical, aliases, frequency; a missing file has no entries, an entry without a name fails the read."""
    rows = _entries(spark, path, schemas.DEALERS)
    named = F.coalesce("canonical", F.raise_error(F.concat(F.lit("dealer entry without canonical name: "), "seq")).cast("string"))
    return rows.select("seq", named.alias("canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("frequency", F.lit(1)).alias("frequency"))


def asset_master(spark: SparkSession, path: str) -> DataFrame:
    rows = _entries(spark, path, schemas.ASSETS)
    return rows.select("seq", "brand", "model", F.coalesce("full_name", F.btrim(F.concat_ws(" ", "brand", "model"))).alias("full_name"))


def labels(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_id and the true fields; ``limit`` takes the first ones in file order."""
    rows = spark.read.schema(schemas.LABELS).option("multiLine", True).json(path).select(F.posexplode("documents").alias("seq", "d"))
    rows = rows if limit is None else rows.where(F.col("seq") < limit)
    return rows.select("seq", "d.doc_id", "d.fields.*")


def yolo_files(spark: SparkSession, folder: str) -> DataFrame:
    """image (the file's stem) and line of each line of the label files."""
    rows = spark.read.text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return rows.where(F.btrim("line") != "").select(F.regexp_replace("file", r"\.txt$", "").alias("image"), "line")


def readable(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the whole Parquet files of a folder, and (path, error) of the files that are not whole.

    A file is whole if its footer can be read and all rows that it speaks of can be decoded. No other file is given up for
    a broken one. Files are judged in tasks; Spark lists no file without bytes.
    """
    kinds = spark.createDataFrame([], schema).schema
    if not _exists(spark, path):
        return spark.createDataFrame([], kinds), spark.createDataFrame([], "path string, error string")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in batch.column(0).to_pylist():
                try:
                    files, inside = file_system(at)
                    with files.open_input_file(inside) as source:
                        found.append((at, pq.ParquetFile(source).metadata.num_rows, None))
                except (OSError, pa.ArrowException) as fault:
                    found.append((at, None, f"{type(fault).__name__}: {fault}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "n", "error"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    told = listed.mapInArrow(footers, "path string, n long, error string")
    rows = spark.read.schema(kinds).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    read = rows.groupBy(F.col("_file").alias("path")).agg(F.count("*").alias("read"), *(F.count(F.col(c)).alias(f"_{k}") for k, c in enumerate(kinds.names)))  # columns are decoded
    whole = F.col("read") + F.least(F.lit(0), *(F.col(f"_{k}") for k in range(len(kinds))))  # the counts are never below zero
    judged = told.join(read.select("path", whole.alias("read")), "path", "left")
    short = F.coalesce("read", F.lit(0)) < F.col("n")
    bad = judged.withColumn("error", F.coalesce("error", F.when(short, F.concat(F.lit("only "), F.coalesce("read", F.lit(0)), F.lit(" of "), "n", F.lit(" rows can be read")))))
    bad = kept(bad.where("error is not null").select("path", "error"))
    return rows.join(bad.select(F.col("path").alias("_file")), "_file", "left_anti").select(*kinds.names), bad


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the whole files of a Parquet table, none where it is missing: what is corrupt counts as absent."""
    return readable(spark, path, schema)[0]


def cache_misses(docs: DataFrame, cache: DataFrame, results: str | None = "tokens") -> DataFrame:
    """Rows of ``docs`` (doc_id, hash) that the cache lacks.

    A cached array ``results`` that is empty counts as lacking (so for recognition); with None any cached row counts (so
    for detection, which may find nothing).
    """
    known = cache if results is None else cache.where(F.size(results) > 0)
    return docs.join(known.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_anti")


def cached(labels: DataFrame, cache: DataFrame) -> DataFrame:
    """``labels`` (doc_id, …) with the first entry of ``cache`` (key ``doc::hash``, …) of its document."""
    entries = cache.withColumn("doc_id", F.split_part("key", F.lit("::"), F.lit(1)))
    first = entries.groupBy("doc_id").agg(F.min_by(F.struct(*cache.columns), "key").alias("entry"))
    return labels.join(first, "doc_id").select(*labels.columns, "entry.*")


def mining_cache(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """filename, page_height and tokens of the ``docs`` of a mining cache, the first ``limit`` of them; none where it is missing."""
    token = "struct<text: string, bbox: array<int>, confidence: double, script: string>"
    schema = f"docs array<struct<filename: string, tokens: array<{token}>, page_height: int>>"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).select(F.inline("docs"))
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("docs").alias("seq", "d"))
    return (rows if limit is None else rows.where(F.col("seq") < limit)).select("d.*")


def masters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The dealer and the asset master of a folder."""
    return dealer_master(spark, f"{folder}/dealer_master.json"), asset_master(spark, f"{folder}/asset_master.json")


def image_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of image (path) and label file (path, …) of the same stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return images.withColumn("stem", stem("path")).join(labels.select(stem("path").alias("stem"), F.col("path").alias("label_path")), "stem")
