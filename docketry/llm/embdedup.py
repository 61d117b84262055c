"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine verification, components.

Vectors of one label are compared if their signs agree on all hyperplanes of at least one table. A pair
at the threshold agrees on one hyperplane with probability 1 - acos(t)/pi; ``bits`` follows the number of
vectors (a bucket should have about ``BUCKET_ROWS``) and the number of tables follows from the recall asked for
at the threshold (closer pairs are found more surely). Every pair that meets is verified by its cosine in
double precision. A pair counts only in the first table in which it meets, so counts need no
deduplication; equal vectors are one row with a weight. A bucket larger than ``PART_ROWS`` is dealt to
pairs of parts, each its own task; a task returns counts and a forest of its links, never the pairs.

Null, zero and non-finite vectors, vectors with a null component, and null labels link with nothing.
Rows that repeat a vec_id are vectors of their own for linking; each returns the counts of its own vector.
A row with null vec_id links with nothing and gets no component. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import written
from docketry.llm.components import components
from docketry.llm.simhash import roots

THRESHOLD = 0.93
RECALL = 0.9999  # chance that a pair exactly at the threshold meets in some table
BUCKET_ROWS = 96
PART_ROWS = 1024


def plan(rows_per_label: int, threshold: float, recall: float, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(bits of a table, tables)."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(6, min(24, math.ceil(math.log2(max(2, rows_per_label / bucket_rows)))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, part_rows: int = PART_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""

    element = vectors.schema["embedding"].dataType.elementType
    kind, wide = ("<f4", 4) if isinstance(element, T.FloatType) else ("<f8", 8)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(1):
                x = v.as_py()
                ok = x and all(c is not None and math.isfinite(c) for c in x) and any(x)
                made.append(np.asarray(x, kind).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["vec_id", "vec", "label"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = written(given.mapInArrow(encode, "vec_id long, vec binary, label string"), "vectors")
    live = rows.where("vec_id is not null and vec is not null and label is not null")
    classes = written(live.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "classes")
    sizes = classes.groupBy("label", F.length("vec").alias("width")).count().agg(F.max("count")).first()
    bits, tables = plan(sizes[0] or 1, threshold, recall)

    def planes(width: int) -> np.ndarray:
        return np.random.default_rng(width).standard_normal((width, tables * bits))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table: the bucket, and the codes of all tables to tell which table comes first."""
        for batch in batches:
            length = np.array([len(v) for v in batch.column("vec").to_pylist()], dtype=np.int64)
            for w in np.unique(length):
                at = np.flatnonzero(length == w)
                part = batch.take(pa.array(at))
                on = (_matrix(part.column("vec"), kind) @ planes(int(w) // wide) > 0).reshape(len(at), tables, bits)
                codes = (on * (1 << np.arange(bits))).sum(axis=2).astype("<i4")
                blob = [c.tobytes() for c in codes]
                for t in range(tables):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "label": part.column("label"),
                            "width": pa.array(np.full(len(at), w // wide, np.int32)),
                            "table": pa.array(np.full(len(at), t, np.int32)),
                            "code": pa.array(codes[:, t]),
                            "node": part.column("node"),
                            "weight": part.column("weight"),
                            "vec": part.column("vec"),
                            "codes": pa.array(blob, pa.binary()),
                        }
                    )

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets alone, to count their rows."""
        for batch in sign(batches):
            yield batch.select(["label", "width", "table", "code"])

    key = ["label", "width", "table", "code"]
    signed = classes.mapInArrow(sign, "label string, width int, table int, code int, node long, weight long, vec binary, codes binary")
    large = (
        classes.mapInArrow(buckets, "label string, width int, table int, code int")
        .groupBy(*key).count().where(F.col("count") > part_rows).select(*key, F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    )
    split = signed.join(written(large, "large-buckets"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "weight", "vec", "codes")

    def compare(group: pa.Table) -> pa.Table:
        low, high, table = (group.column(c)[0].as_py() for c in ("low", "high", "table"))
        node, weight, side = (group.column(c).to_numpy() for c in ("node", "weight", "own"))
        vec = _matrix(group.column("vec"), kind)
        vec = vec / np.sqrt((vec * vec).sum(axis=1))[:, None]
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), "<i4").reshape(len(node), tables)
        n, count, a, b = len(node), np.zeros(len(node), np.int64), [], []
        for i in range(0, n, 1024):
            hit = vec[i : i + 1024] @ vec.T >= threshold
            x, y = np.nonzero(hit)
            x = x + i
            ok = x != y
            if low != high:
                ok &= side[x] != side[y]
            x, y = x[ok], y[ok]
            if table:
                first = np.ones(len(x), bool)
                for t in range(table):
                    first &= codes[x, t] != codes[y, t]
                x, y = x[first], y[first]
            np.add.at(count, x, weight[y])
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(node, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        label = order[roots(n, rank[a], rank[b])][rank]
        some = np.flatnonzero(count)
        return pa.table({"node": node[some], "links": count[some], "lowest": node[label[some]]})

    found = written(dealt.groupBy(*key, "low", "high").applyInArrow(compare, "node long, links long, lowest long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("lowest").alias("b")))
    done = classes.join(counts, "node", "left").join(groups, "node", "left")
    done = done.select("label", "vec", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component"))
    joined = rows.join(done, ["label", "vec"], "left")
    component = F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "vec_id"))
    counted = F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0)))
    return joined.select("vec_id", counted.cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
