"""A cache of what models have said about documents, filled by the misses only.

A folder holds a Parquet folder for each append and a small commit record that names it. An append counts once its
record is there: the record is written under another name and renamed, after the data. So a job that dies leaves no
half entry, a task that runs again leaves no second one, and appends at the same time do not hinder each other, as each
has a record of its own. Entries of one document and hash that were made twice at the same time count once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources import adapters, files


class StageCache:
    """Entries (doc_id, hash, items, seconds) by stage below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _records(self, stage: str) -> dict[str, dict]:
        """The commit records of a stage by name; what cannot be read counts as absent."""
        at = self._path(f"{self.folder}/{stage}/_commits")
        if not self._fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        found = {}
        for name in sorted(n for n in names if n.endswith(".json")):
            stream = self._fs.open(self._path(f"{self.folder}/{stage}/_commits/{name}"))
            try:
                found[name] = json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                continue
            finally:
                stream.close()
        return found

    def _commit(self, stage: str, data: str, replaces: list[str]) -> None:
        at = f"{self.folder}/{stage}/_commits/{data}"
        out = self._fs.create(self._path(f"{at}.tmp"), True)
        out.write(bytearray(json.dumps({"data": data, "replaces": replaces}).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{at}.tmp"), self._path(f"{at}.json")):
            raise OSError(f"the commit {at} could not be put in place")

    def _live(self, stage: str) -> list[str]:
        records = self._records(stage)
        gone = {name for r in records.values() for name in r["replaces"]}
        return [r["data"] for name, r in records.items() if name not in gone]

    def entries(self, stage: str, schema: str) -> DataFrame:
        """doc_id, hash, items (an array of ``schema``) and seconds of what the models said without a fault."""
        whole = f"doc_id string, hash string, items array<struct<{_fields(schema)}>>, seconds double, error string"
        live = [d for d in self._live(stage) if self._fs.exists(self._path(f"{self.folder}/{stage}/{d}"))]
        if not live:
            return self.spark.createDataFrame([], whole).drop("error")
        paths = [f"{self.folder}/{stage}/{d}" for d in live]
        rows = self.spark.read.schema(whole).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*paths).where("error is null")
        if len(paths) > 1:  # two appends at the same time may both have an entry
            first = F.min_by(F.struct("items", "seconds"), F.struct(F.size("items") == 0, "file"))
            rows = rows.withColumn("file", F.col("_metadata.file_path")).groupBy("doc_id", "hash").agg(first.alias("e")).select("doc_id", "hash", "e.*")
        return rows.select("doc_id", "hash", "items", "seconds")

    def append(self, stage: str, rows: DataFrame, replaces: list[str] | None = None) -> str:
        """Write ``rows`` (doc_id, hash, items, seconds, error), then commit them; returns the name of their folder."""
        data = uuid.uuid4().hex
        rows.select("doc_id", "hash", "items", "seconds", "error").write.option("compression", "zstd").parquet(f"{self.folder}/{stage}/{data}")
        self._commit(stage, data, replaces or [])
        return data

    def compact(self, stage: str, schema: str) -> None:
        """One append in place of all; those made meanwhile stay."""
        names = [n for n, r in self._records(stage).items()]
        self.append(stage, self.entries(stage, schema).withColumn("error", F.lit(None).cast("string")), names)

    def fill(self, stage: str, docs: DataFrame, load: Callable[[], adapters.Model], schema: str, empty_counts: bool) -> DataFrame:
        """doc_id, hash, items, seconds and error of each of ``docs`` (doc_id, hash, and what the model reads).

        The model sees the misses only, each once; a fault is told but not remembered. ``empty_counts``: whether an entry
        without items is an answer (a detector may find nothing) or is asked again (a recogniser).
        """
        before = self.entries(stage, schema)
        known = before if empty_counts else before.where(F.size("items") > 0)
        hits = docs.select("doc_id", "hash").join(known, ["doc_id", "hash"]).withColumn("error", F.lit(None).cast("string"))
        misses = files.cache_misses(docs, before, None if empty_counts else "items")
        made = self.append(stage, adapters.items_of(misses, load, ["doc_id", "hash"], schema))
        fresh = self.spark.read.schema(hits.schema).parquet(f"{self.folder}/{stage}/{made}")
        return hits.select(*fresh.columns).unionByName(fresh)


def _fields(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split(None, 1)[1]}" for c in schema.split(", "))


def mining_documents(cache: StageCache, documents: DataFrame, load: Callable[[], adapters.Model], schema: str, limit: int | None = None, use_cache: bool = True) -> DataFrame:
    """filename, tokens and seconds of the first ``limit`` PNG files by name, from the cache where it has them, else read
    afresh; files that cannot be read are left out. ``documents``: path, name, hash, content. A corrupt cache is no cache."""
    wanted = documents.where(F.lower(F.substring_index("name", ".", -1)) == "png").select(F.col("name").alias("doc_id"), "hash", "content")
    if limit is not None:
        wanted = wanted.orderBy("doc_id").limit(limit)
    if use_cache:
        read = cache.fill("mining", wanted, load, schema, empty_counts=True)
    else:
        made = cache.append("mining", adapters.items_of(wanted, load, ["doc_id", "hash"], schema))
        read = cache.spark.read.parquet(f"{cache.folder}/mining/{made}")
    return read.where("error is null").select(F.col("doc_id").alias("filename"), F.col("items").alias("tokens"), "seconds")
