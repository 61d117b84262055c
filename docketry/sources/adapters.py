"""Seams for recognition, detection and language models.

An adapter is a function from a batch of documents to rows. It is started once in each Python worker, gets
whole Arrow batches, and a document on which it fails becomes a row with an error, so a bad page never
fails a job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

Model = Callable[[dict], list[dict]]


def apply_model(docs: DataFrame, load: Callable[[], Model], key: str, schema: str) -> DataFrame:
    """``key``, the fields of ``schema``, ``error`` and ``seconds`` for each row that ``load()`` makes of a document.

    A document of which it makes none is one row of nulls, so that its time is kept.
    """
    whole = StructType([docs.schema[key], *StructType.fromDDL(schema).fields, StructField("error", StringType()), StructField("seconds", DoubleType())])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            rows = []
            for record in batch.to_pylist():
                began = time.perf_counter()
                try:
                    made = [{key: record[key], "error": None, **row} for row in model(record)] or [{key: record[key], "error": None}]
                except Exception as problem:  # the contract: an error column, never a failed task
                    made = [{key: record[key], "error": f"{type(problem).__name__}: {problem}"}]
                spent = time.perf_counter() - began
                rows += [row | {"seconds": spent} for row in made]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.mapInArrow(run, whole)


def items_of(docs: DataFrame, load: Callable[[], Model], keys: list[str], schema: str) -> DataFrame:
    """A row for each document: ``keys``, ``items`` (an array of ``schema``), ``seconds`` and ``error``."""
    item = StructType.fromDDL(schema)
    whole = StructType([*(docs.schema[k] for k in keys), StructField("items", ArrayType(item)), StructField("seconds", DoubleType()), StructField("error", StringType())])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one document at a time: a page may be large
                record = batch.slice(i, 1).to_pylist()[0]
                began = time.perf_counter()
                try:
                    made = {"items": [{**dict.fromkeys(item.names), **row} for row in model(record)], "error": None}
                except Exception as problem:  # the contract: an error column, never a failed task
                    made = {"items": [], "error": f"{type(problem).__name__}: {problem}"}
                rows.append({k: record[k] for k in keys} | made | {"seconds": time.perf_counter() - began})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.mapInArrow(run, whole)


def text_recogniser() -> Model:
    """A stand-in for recognition: words of the ``text`` field at fixed places."""

    def read(record: dict) -> list[dict]:
        out = []
        for row, line in enumerate(record["text"].split("\n")):
            for place, word in enumerate(w for w in line.split(" ") if w):
                out.append({"tok_idx": len(out), "text": word, "x1": 60 + 110 * place, "y1": 40 + 60 * row, "x2": 160 + 110 * place, "y2": 60 + 60 * row, "conf": 0.95})
        return out

    return read


def page_reader() -> Model:
    """A stand-in for decoding and recognition: the file's bytes are the page's text."""
    words = text_recogniser()
    return lambda record: words({"text": bytes(record["content"]).decode()})
