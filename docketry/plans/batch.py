"""From a folder of documents to JSON lines: listing, models behind adapters, extraction, error records, one line each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import assemble
from docketry.plans.pipeline import extract
from docketry.sources import adapters, files, shared, sinks
from docketry.sources.cache import StageCache

TOKEN = "tok_idx int, text string, x1 int, y1 int, x2 int, y2 int, conf double"
BOX = "seq long, cls string, x1 int, y1 int, x2 int, y2 int, conf double"


def run_folder(spark: SparkSession, folder: str, dealers: DataFrame, assets: DataFrame, recogniser: Callable[[], adapters.Model] = adapters.page_reader, detector: Callable[[], adapters.Model] | None = None, second_tier: Callable[[DataFrame], DataFrame] | None = None, cache: StageCache | None = None) -> DataFrame:
    """A nested result for each file of ``folder``, named by the file.

    Each model reads each file once: what it says goes to ``cache`` (without one, to a cache of this run in the shared
    folder), and files that the cache knows by name and content are not read at all. Files of other kinds get
    ``unsupported_format``, files on which the recogniser fails ``corrupt_input``; a page without tokens gives an empty
    result. A detector that fails leaves a document without boxes, as one that finds none does. ``second_tier`` answers
    (doc_id, answer) for the fields (doc_id, full_text, fields) that are missing, and is asked once.
    """
    cache = cache or StageCache(spark, shared.new_path(spark, "models"))
    every = files.all_files(spark, folder)
    known = every.where(files.supported(F.col("path"))).select(F.col("name").alias("doc_id"), "hash", "content")
    read = cache.fill("ocr", known, recogniser, TOKEN, empty_counts=False)
    tokens = read.where("error is null").select("doc_id", F.inline("items"))
    seconds = read.select("doc_id", F.col("seconds").alias("processing_time_sec"))
    boxes = cache.fill("detections", known, detector, BOX, empty_counts=True).where("error is null").select("doc_id", F.inline("items")) if detector else spark.createDataFrame([], f"doc_id string, {BOX}")
    found = extract(tokens, boxes, dealers, assets, second_tier, seconds)
    broken = read.where("error is not null").select("doc_id", F.concat(F.lit("corrupt_input: "), "error").alias("error"))
    other = every.where(~files.supported(F.col("path"))).select(F.col("name").alias("doc_id"), F.concat(F.lit("unsupported_format: "), "name").alias("error"))
    blank = read.where("error is null and size(items) = 0").select("doc_id", F.lit(None).cast("string").alias("error"))
    return found.unionByName(assemble.failed(broken.unionByName(other).unionByName(blank)))


def folder_to_lines(spark: SparkSession, folder: str, target: str, dealers: DataFrame, assets: DataFrame, flat: bool = False, **models) -> DataFrame:
    """``run_folder`` written as JSON lines to ``target``; returns the lines as they were written, in the order of names."""
    sinks.json_lines(run_folder(spark, folder, dealers, assets, **models), target, flat)
    lines = spark.read.schema(schemas.RESULT).json(target) if not flat else spark.read.json(target)
    return lines.orderBy("doc_id")
