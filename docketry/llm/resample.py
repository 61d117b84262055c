"""Importance resampling toward a target: hashed n-gram features, log-ratio gains, Gumbel top-k.

The features of a text are its runs of one to three words. A batch's UTF-8 buffer is classified byte by byte with a
lookup table; words begin and end where neighbouring bytes differ in class. The CRC-32 of all words advances at once,
four bytes a step, by tables; a run of two or three words starts from the state that its first words ended in, so each
word's bytes are looked up once and no feature is ever built as a string.

One pass over documents and target counts features in buckets (a row for each bucket and task, summed by Spark); a
second adds up the gains of each document. Documents are then sorted by range over all tasks, and a task's ranks start
where the tasks before it end. The driver sees bucket counts and one number for each range.

A null text has no words. Documents of fewer than ``least_words`` words are never drawn; no document has more than one
rank. Rows that repeat a doc_id are documents of their own, equal ones in any order. A null doc_id is hashed as an empty
one, and comes last among equal scores. Texts are read whole, some at a time. An empty target or empty documents count
zero everywhere; no documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import vec
from docketry.llm.common import written

BUCKETS = 10_000
SHARE = (5, 100)  # of the documents that are long enough
LEAST_WORDS = 20
SEED = 42
PIECE = 1 << 20  # bytes of text that are hashed at once
FEW = 48  # words still unfinished below which they are finished one by one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 (reflected polynomial EDB88320): one byte on from a low byte, four bytes on from a low and a high half."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    halves = [np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)]
    for _ in range(4):
        halves = [one[h & 255] ^ (h >> 8) for h in halves]
    return one, halves[0], halves[1]


_ONE, _LOW, _HIGH = _crc_tables()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, each word's start and end, and the word offsets of the rows."""
    low = _LOWER[data]
    inside = _WORD[low]
    first, last = inside.copy(), inside.copy()
    if len(low):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(low))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return low, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


class Automaton:
    """CRC-32 states carried over the bytes of all words of a piece at the same time."""

    def __init__(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.order = np.argsort(-size, kind="stable")
        self.start, self.size, self.low = start[self.order], size[self.order], low
        padded = np.concatenate([low, np.zeros(4, np.uint8)])
        four = np.lib.stride_tricks.as_strided(padded, (max(len(padded) - 3, 0), 4), (1, 1))
        four = np.ascontiguousarray(four).view("<u4").ravel()
        self.steps, k, negative = [], 0, -(self.size >> 2)
        while (live := int(np.searchsorted(negative, -k, side="left"))) >= FEW:
            self.steps.append(four[self.start[:live] + 4 * k])
            k += 1
        self.long = int(np.searchsorted(negative, -k, side="left"))  # words that go on after the common steps
        self.done = 4 * k
        self.rest = []
        for r in range(3):
            at = np.flatnonzero((self.size & 3) > r)
            at = at[at >= self.long]
            if len(at):
                self.rest.append((at, low[self.start[at] + (self.size[at] & ~3) + r]))

    def advance(self, state: np.ndarray) -> np.ndarray:
        """The state after each word, from the state before it."""
        s = state[self.order]
        for step in self.steps:
            x = s[: len(step)] ^ step
            s[: len(step)] = _LOW[x & np.uint32(0xFFFF)] ^ _HIGH[x >> np.uint32(16)]
        for at, byte in self.rest:
            x = s[at]
            s[at] = _ONE[(x ^ byte) & 255] ^ (x >> 8)
        for i in range(self.long):
            tail = self.low[self.start[i] + self.done : self.start[i] + self.size[i]]
            s[i] = zlib.crc32(tail, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out = np.empty_like(s)
        out[self.order] = s
        return out


def feature_crcs(data: np.ndarray, offsets: np.ndarray, longest: int = 3) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1, 2, ... ``longest`` words, by their last word: the CRC-32, whether there is such a run; word offsets."""
    low, start, end, rows = words(data, offsets)
    automaton = Automaton(low, start, end)
    place = np.arange(len(start)) - np.repeat(rows[:-1], np.diff(rows))
    state = automaton.advance(np.full(len(start), 0xFFFFFFFF, dtype=np.uint32))
    crcs, there = [~state], [np.ones(len(start), dtype=bool)]
    for n in range(1, longest):
        before = np.roll(state, 1)
        state = automaton.advance(_ONE[(before ^ np.uint32(0x20)) & 255] ^ (before >> 8))
        crcs.append(~state)
        there.append(place >= n)
    return crcs, there, rows


def _texts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.col("text").cast("string").alias("_text"))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of all features of the column ``text`` of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = vec.flat(batch.column(0))
            for a, b in vec.pieces(offsets, PIECE):
                crcs, there, _ = feature_crcs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for crc, ok in zip(crcs, there):
                    total += np.bincount(crc[ok] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "part"])

    return _texts(rows).mapInArrow(run, "bucket int, part long").groupBy("bucket").agg(F.sum("part").alias("count"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of (share in the target / share in the source)) of each bucket, with one added to each count."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = (((target.get(b, 0) + 1.0) * (s_all + buckets)) / ((source.get(b, 0) + 1.0) * (t_all + buckets)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.flat(batch.column(1))
            out = np.zeros((3, batch.num_rows), np.int64)
            for a, b in vec.pieces(offsets, PIECE):
                crcs, there, rows = feature_crcs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out[0, a:b] = np.diff(rows)
                for crc, ok in zip(crcs, there):
                    out[1, a:b] += vec.row_sums(ok.astype(np.int64), rows)
                    out[2, a:b] += vec.row_sums(np.where(ok, gain[crc % np.uint32(len(gain))], 0), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel deviate) that the seed and the doc_id alone decide."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], by: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in ``order`` over all tasks."""
    fields = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            place = pa.array(np.arange(at + 1, at + 1 + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), place], [*fields, "_range", "_place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(sorted_rows.mapInArrow(number, f"{kinds}, _range int, _place long"), "ranked")
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    starts, before = [], 0
    for part, count in sizes:
        starts.append((part, before))
        before += count
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _before long")  # a row for each range
    return placed.join(F.broadcast(offsets), "_range").select(*fields, (F.col("_place") + F.col("_before")).alias(by))


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of each of ``docs`` (doc_id, text)."""
    found = {}
    both = bucket_counts(docs, buckets).select("bucket", "count", F.lit(0).alias("side")).unionAll(bucket_counts(target, buckets).select("bucket", "count", F.lit(1).alias("side")))
    for r in both.collect():  # at most two rows a bucket
        found[r["side"], r["bucket"]] = r["count"]
    gain = gains(*({b: n for (side, b), n in found.items() if side == k} for k in (0, 1)), buckets)
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(seed))
    in_draw = scored.withColumn("_out", (F.col("n_words") < least_words).cast("int")).drop("n_words")
    order = [F.col("_out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = ranked(written(in_draw, "importance"), order, "_rank")
    long_enough = placed.where("_out = 0").count()
    drawn = long_enough * share[0] // share[1]
    rank = F.when((F.col("_out") == 0) & (F.col("_rank") <= drawn), F.col("_rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with all their columns. Rows that repeat a doc_id are drawn together."""
    drawn = importance(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")
