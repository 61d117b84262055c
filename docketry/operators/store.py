"""The document store and its dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import inr, size_kb
from docketry.operators.normalize import latest


def insert(store: DataFrame, rows: DataFrame) -> DataFrame:
    return store.unionByName(rows)


def newest_first(store: DataFrame) -> DataFrame:
    return store.orderBy(F.desc("uploadedAt"), F.desc("seq"))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each id: that of the highest ``seq``."""
    return latest(store.unionByName(rows), ["id"], [F.desc("seq")])


def patch(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns of ``changes`` (by id) over those of ``store`` where not null."""
    names = [c for c in changes.columns if c != "id"]
    joined = store.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in names)), "id", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else c for c in store.columns))


def merge_in_flight(server: DataFrame, local: DataFrame) -> DataFrame:
    """Server rows and those local ones in processing that the server does not have."""
    return local.where("status = 'processing'").join(server, "id", "left_anti").unionByName(server)


def search(store: DataFrame, text: str, status: str | None = None) -> DataFrame:
    hit = F.contains(F.lower(F.concat_ws(" ", "fileName", "dealerName", "modelName")), F.lit(text.lower()))
    return store.where(hit if status is None else hit & (F.col("status") == status))


def public(store: DataFrame) -> DataFrame:
    return store.select(*(c for c in store.columns if not c.startswith("_")))


def extracted_fields(results: DataFrame) -> Column:
    """What the store shows of nested results: dashes for what is missing, rupees set apart, boxes in whole pixels."""
    f = lambda name, part="value": F.col(f"fields.{name}.{part}")
    shown = lambda name: F.coalesce(F.nullif(f(name), F.lit("")), F.lit("—"))
    whole = lambda name: F.transform(f(name, "bbox"), lambda c: F.rint(c.cast("double")).cast("int"))
    power = F.coalesce(F.concat(f("horse_power").cast("string"), F.lit(" HP")), F.lit("—"))
    return F.struct(
        shown("dealer_name").alias("dealerName"), shown("model_name").alias("modelName"), power.alias("horsePower"), inr(f("asset_cost"), "₹ ").alias("assetCost"),
        F.coalesce(f("signature", "present"), F.lit(False)).alias("signatureDetected"), F.coalesce(f("stamp", "present"), F.lit(False)).alias("stampDetected"),
        whole("signature").alias("signatureBbox"), whole("stamp").alias("stampBbox"),
    )


def record(results: DataFrame) -> DataFrame:
    """The store's record of nested results with fileName, bytes, mimeType and uploadedAt."""
    kind = F.lower(F.regexp_extract("fileName", r"\.([^.]*)$", 1))
    return results.select(
        F.col("doc_id").alias("id"), "fileName", size_kb(F.col("bytes")).alias("fileSize"), F.when(kind != "", kind).otherwise("unknown").alias("fileType"),
        F.coalesce(F.nullif("mimeType", F.lit("")), F.lit("application/octet-stream")).alias("mimeType"), F.lit("completed").alias("status"),
        F.rint(F.coalesce("confidence", F.lit(0.0)) * 100).cast("int").alias("confidence"), F.format_string("%.1fs", F.coalesce("processing_time_sec", F.lit(0.0))).alias("processingTime"),
        F.lit("English").alias("language"), F.lit("Tractor Quotation").alias("documentType"), extracted_fields(results).alias("extractedFields"), "uploadedAt",
    )


def remove(store: DataFrame, id: str) -> tuple[DataFrame, bool]:
    """The store without a document, and whether it was there."""
    return store.where(F.col("id") != id), not store.where(F.col("id") == id).isEmpty()


def kpis(store: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    per = lambda s: F.coalesce(F.try_divide(s, done), F.lit(0.0))
    seconds = F.regexp_replace("processingTime", "s$", "").try_cast("double")
    ok = F.col("status") == "completed"
    return store.agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        F.coalesce(F.try_divide(done * 100.0, F.count("*")), F.lit(0.0)).alias("completion_pct"),
        per(F.sum(F.when(ok, F.col("confidence")).otherwise(0))).alias("avg_confidence"),
        per(F.sum(F.when(ok, F.coalesce(seconds, F.lit(0.0))).otherwise(0.0))).alias("avg_seconds"),
    )


def daily_volume(store: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """Uploads of each of the ``days`` days up to ``last_day``, zeros included. Days are the text's first ten characters."""
    spine = store.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    counts = store.groupBy(F.to_date(F.substring("uploadedAt", 1, 10)).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def confidence_buckets(store: DataFrame) -> DataFrame:
    c = F.col("confidence")
    ok = (F.col("status") == "completed") & (c != 0)
    bands = (("90+", c >= 90), ("80-89", (c >= 80) & (c < 90)), ("70-79", (c >= 70) & (c < 80)), ("<70", c < 70))
    sums = store.agg(*(F.count_if(ok & b).alias(n) for n, b in bands))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n, _ in bands))).alias("r")).select("r.*")


def languages(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("lang", F.lit("Unknown")).alias("lang")).agg(F.count("*").alias("n"))


def queue_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("status").agg(F.count("*").alias("n"))
