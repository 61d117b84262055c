"""Writers: JSON lines, one file a document, byte-stable master data, label rows and cache appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.assemble import legacy


def json_lines(results: DataFrame, path: str, flat: bool = False) -> None:
    """A compact line for each document."""
    (legacy(results) if flat else results).write.mode("overwrite").json(path)


def json_per_document(results: DataFrame, path: str) -> None:
    """A folder for each document with its record."""
    body = F.to_json(F.struct(*(c for c in results.columns if c != "doc_id")))
    results.select("doc_id", body.alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def _master(entries: DataFrame, order: list[str]) -> DataFrame:
    """One pretty record; a master is a dimension of the size of a catalogue, so it fits one row."""
    item = F.struct(*order, F.struct(*entries.columns).alias("e"))
    rows = entries.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("entries"))
    return rows.select(F.to_json(F.struct(F.lit(1).alias("version"), "entries"), {"pretty": "true"}).alias("value"))


def dealer_master(entries: DataFrame, path: str) -> None:
    """Entries by canonical name, aliases in order, keys always alike: equal data gives equal bytes."""
    _master(entries.select("canonical", F.sort_array("aliases").alias("aliases"), "frequency"), ["canonical"]).coalesce(1).write.mode("overwrite").text(path)


def asset_master(entries: DataFrame, path: str) -> None:
    _master(entries.select("brand", "model", "full_name"), ["full_name", "brand"]).coalesce(1).write.mode("overwrite").text(path)


def yolo_files(lines: DataFrame, path: str) -> None:
    """Label lines (image, line) under their image."""
    lines.select("image", F.col("line").alias("value")).write.mode("overwrite").partitionBy("image").text(path)


def pseudo_labels(rows: DataFrame, path: str) -> None:
    """Records that are sure in all four text fields, with confidences at three digits."""
    rounded = [F.bround(c, 3).alias(c) if c.endswith("_conf") else F.col(c) for c in rows.columns]
    rows.select(*rounded).write.mode("overwrite").json(path)


def cache_append(results: DataFrame, path: str) -> None:
    """Append stage results (doc_id, hash, tokens, …), partitioned by the first digits of the hash."""
    results.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
