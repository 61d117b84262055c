"""Documents that arrive in parts: a document's tokens may be spread over micro-batches and give one result.

A row of the stream is one part: doc_id, part (from 0; null for a mere announcement), parts (how many there are), sent
and tokens. The state holds the parts of unfinished documents; a part that comes twice counts once, and what comes
after a document is done is ignored for as long as ``patience`` remembers it. A document goes from ``queued`` (announced) over
``processing`` to ``completed``, or to ``failed`` if parts are still missing ``patience`` after the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketry.streaming.documents import extract_batch

TOKEN = "tok_idx int, text string, x1 int, y1 int, x2 int, y2 int, conf double"
PART = f"doc_id string, part int, parts int, sent timestamp, tokens array<struct<{', '.join(c.replace(' ', ': ') for c in TOKEN.split(', '))}>>"
STATUS = "doc_id string, status string, seen int, parts int, tokens string"
PATIENCE_S = 3600


def part_stream(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(PART).option("maxFilesPerTrigger", files_at_once).parquet(path)


def gathered(parts: DataFrame, patience_s: int = PATIENCE_S) -> DataFrame:
    """A row (doc_id, status, seen, parts, tokens as JSON) for each change of a document's status; tokens only once whole."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = lambda status, n, tokens=None: pd.DataFrame([(key[0], status, n, total, tokens)], columns=["doc_id", "status", "seen", "parts", "tokens"])
        total, held, status = state.get if state.exists else (0, "{}", "")
        held = json.loads(held)
        if state.hasTimedOut:
            state.remove()
            if status != "completed":
                yield told("failed", len(held))
            return
        latest, before = 0, status
        for frame in frames:
            for r in frame.itertuples():
                latest = max(latest, int(r.sent.timestamp() * 1000))
                if status != "completed":
                    total = max(total, 0 if pd.isna(r.parts) else int(r.parts))
                    if not pd.isna(r.part):
                        held.setdefault(str(int(r.part)), json.loads(r.tokens or "[]"))
        tokens = None
        if status != "completed":
            whole = total > 0 and all(str(k) in held for k in range(total))
            status = "completed" if whole else "processing" if held else "queued"
            tokens = json.dumps([t for k in range(total) for t in held[str(k)]]) if whole else None
        seen = total if status == "completed" else len(held)
        state.update((total, json.dumps({} if status == "completed" else held), status))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1000 * patience_s)
        if status != before:
            yield told(status, seen, tokens)

    rows = parts.where("doc_id is not null").withColumn("sent", F.coalesce("sent", F.lit(0).cast("timestamp"))).withWatermark("sent", f"{patience_s} seconds").withColumn("tokens", F.to_json("tokens"))
    return rows.groupBy("doc_id").applyInPandasWithState(step, STATUS, "parts int, held string, status string", "append", GroupStateTimeout.EventTimeTimeout)


def run_documents(parts: DataFrame, target: str, checkpoint: str, patience_s: int = PATIENCE_S) -> StreamingQuery:
    """Keep ``target``/changes (status by micro-batch) and ``target``/results (fields of completed documents). A batch that
    runs again writes over itself."""

    def write(batch: DataFrame, number: int) -> None:
        at = f"{target}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        whole = batch.sparkSession.read.schema(STATUS).parquet(at).where("status = 'completed'")
        tokens = whole.select("doc_id", F.inline(F.from_json("tokens", f"array<struct<{', '.join(c.replace(' ', ': ') for c in TOKEN.split(', '))}>>")))
        results = whole.select("doc_id").join(extract_batch(tokens), "doc_id", "left")
        results.write.mode("overwrite").parquet(f"{target}/results/batch={number}")

    return gathered(parts, patience_s).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, status, seen and parts of each document, as it is now."""
    rows = spark.read.schema(f"{STATUS}, batch long").parquet(f"{target}/changes")
    rank = F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(("queued", "processing", "failed", "completed")) for x in (s, k))), F.col("status"))
    last = F.max_by(F.struct("status", "seen", "parts"), F.struct("batch", rank))
    return rows.groupBy("doc_id").agg(last.alias("s")).select("doc_id", "s.*")
