"""Nested results, flat legacy records and error records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _value(value: Column, confidence: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def _visual(box: Column, confidence: Column) -> Column:
    return F.struct(box.isNotNull().alias("present"), box.alias("bbox"), F.when(box.isNotNull(), confidence).otherwise(0.0).alias("confidence"))


def nested(rows: DataFrame) -> DataFrame:
    """One record a document from the flat columns of ``rows``; time is rounded to 2 and cost to 6 digits."""
    fields = F.struct(
        _value(F.col("dealer_name"), F.col("dealer_conf")).alias("dealer_name"),
        _value(F.col("model_name"), F.col("model_conf")).alias("model_name"),
        _value(F.col("horse_power").cast("int"), F.col("hp_conf")).alias("horse_power"),
        _value(F.col("asset_cost").cast("bigint"), F.col("cost_conf")).alias("asset_cost"),
        _visual(F.col("signature_box"), F.col("signature_conf")).alias("signature"),
        _visual(F.col("stamp_box"), F.col("stamp_conf")).alias("stamp"),
    )
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), fields.alias("fields"), "confidence", F.bround("processing_time_sec", 2).alias("processing_time_sec"), F.bround("cost_estimate_usd", 6).alias("cost_estimate_usd"), F.lit(None).cast("string").alias("error"))


def legacy(results: DataFrame) -> DataFrame:
    """Flat values of nested results."""
    f = lambda name, part="value": F.col(f"fields.{name}.{part}")
    return results.select(
        "doc_id", f("dealer_name").alias("dealer_name"), f("model_name").alias("model_name"), f("horse_power").alias("horse_power"), f("asset_cost").alias("asset_cost"),
        f("signature", "present").alias("signature_present"), f("signature", "bbox").alias("signature_bbox"), f("stamp", "present").alias("stamp_present"), f("stamp", "bbox").alias("stamp_bbox"),
        "confidence", "processing_time_sec", "cost_estimate_usd", "error",
    )


def legacy_json(results: DataFrame) -> DataFrame:
    """One JSON line a document; null keys, the error among them, are left out."""
    flat = legacy(results)
    return flat.select("doc_id", F.to_json(F.struct(*flat.columns), {"ignoreNullFields": "true"}).alias("json"))


def failed(docs: DataFrame) -> DataFrame:
    """Empty results for (doc_id, error): unsupported_format, corrupt_input or ingestion_failed."""
    nothing = {c: F.lit(None).cast("string") for c in ("dealer_name", "model_name")}
    zero = ("dealer_conf", "model_conf", "hp_conf", "cost_conf", "signature_conf", "stamp_conf", "confidence", "processing_time_sec", "cost_estimate_usd")
    rows = docs.withColumns(nothing | {c: F.lit(0.0) for c in zero} | {"horse_power": F.lit(None).cast("int"), "asset_cost": F.lit(None).cast("bigint")} | {c: F.lit(None).cast("array<int>") for c in ("signature_box", "stamp_box")})
    made = nested(rows).drop("error")
    return made.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "error"), "doc_id")
