"""Minimum-cost-flow resharding by bytes.

Rows have an old shard. Sizes of the old shards and capacities of the new ones give a transport problem
whose cost is a byte moved; its minimum-cost flow says how many bytes go from each old shard to each new
one. The transfers are made in blocks: the rows of an old shard of one size class and hash bucket. A block
that lies across the border of two transfers is parted row by row; small rows come last in a shard, so the
borders fall between them and new sizes are nearly equal. The driver sees block sizes only, at most
``MAX_BLOCKS`` (or 62 for each old shard, one a size class, if that is more); blocks then hold more rows each. Slots
number the rows of a new shard without gaps, by block offsets and ranks in a block. A shard is written in files of
about ``FILE_BYTES``, each by a task of its own, and only shards that gain or lose rows are written.

Null texts have no bytes; a null doc_id hashes like any value. Rows of equal text, and equal rows, are rows of their
own with places of their own: which of two equal rows gets which of their places is open, and no law ties rows of equal
text to one shard. A very long text is a block's last row or a block of its own. An empty table gives no rows. Other
columns are carried along unchanged, whatever their names: where one is called ``shard`` or ``slot``, the placement's
column gets an underscore more.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import new_path, written

OLD_SHARDS, NEW_SHARDS = 32, 40
ROW_BYTES = 16
BLOCK_ROWS = 4096
MAX_BLOCKS = 100_000
FILE_BYTES = 128 << 20  # text bytes of a shard's file


def minimum_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (i, j) that carry all of ``supply`` within ``capacity`` at the least total of ``cost(i, j)`` a unit.

    Successive shortest paths in the residual graph, found by a queue-based label-correcting search.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    ends: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, most: int, unit: int) -> None:
        for x, y, r, u in ((a, b, most, unit), (b, a, 0, -unit)):
            out[x].append(len(ends))
            ends.append(y)
            room.append(r)
            price.append(u)

    for i in range(n):
        arc(source, i, supply[i], 0)
    for j in range(m):
        arc(n + j, sink, capacity[j], 0)
    between = {}
    for i in range(n):
        for j in range(m):
            between[len(ends)] = (i, j)
            arc(i, n + j, supply[i], cost(i, j))
    while True:
        best: list[float] = [float("inf")] * (n + m + 2)
        via = [-1] * (n + m + 2)
        best[source] = 0
        queue, queued = deque([source]), [False] * (n + m + 2)
        while queue:
            at = queue.popleft()
            queued[at] = False
            for e in out[at]:
                if room[e] > 0 and best[at] + price[e] < best[ends[e]]:
                    best[ends[e]], via[ends[e]] = best[at] + price[e], e
                    if not queued[ends[e]]:
                        queued[ends[e]] = True
                        queue.append(ends[e])
        if via[sink] < 0:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = ends[via[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    return {pair: room[e ^ 1] for e, pair in between.items() if room[e ^ 1]}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def old_shard(shards: int = OLD_SHARDS) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def text_size() -> Column:
    return F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long") + ROW_BYTES


def text_crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def reshard(docs: DataFrame, shards: int = NEW_SHARDS, given: Column | None = None, given_shards: int = OLD_SHARDS, carry: bool = True) -> DataFrame:
    """``docs`` (all columns in struct ``row`` if ``carry``) with doc_id, size, text_crc32, old_shard, shard and slot.

    ``given`` is the shard that a row is in, from 0 to ``given_shards`` - 1; by default a hash of doc_id.
    """
    spark = docs.sparkSession
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select("doc_id", text_size().alias("size"), text_crc32().alias("text_crc32"), (given if given is not None else old_shard(given_shards)).alias("old_shard"), *whole)
    total = docs.count()
    buckets = max(1, round(total / max(BLOCK_ROWS, 16 * total / MAX_BLOCKS) / given_shards / 4))
    block = ["old_shard", "class", "bucket"]
    rows = rows.withColumn("class", -F.floor(2 * F.log2("size")).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(buckets)).cast("int"))
    sums = rows.groupBy(*block).agg(F.sum("size").alias("bytes")).orderBy(*block).collect()

    supply = [0] * given_shards
    for b in sums:
        supply[b.old_shard] += b.bytes
    flow = minimum_cost_flow(supply, even(sum(supply), shards), lambda i, j: int(i != j))
    cuts: dict[int, list[tuple[int, int]]] = {}
    for i in range(given_shards):
        end = 0
        for j in sorted(range(shards), key=lambda j, i=i: (j != i, j)):
            if flow.get((i, j)):
                end += flow[i, j]
                cuts.setdefault(i, []).append((end, j))
    plan, at = [], dict.fromkeys(range(given_shards), 0)
    for b in sums:
        begin, end = at[b.old_shard], at[b.old_shard] + b.bytes
        at[b.old_shard] = end
        own = [(upto - begin, to) for upto, to in cuts[b.old_shard] if upto > begin]
        last = next(k for k, (upto, _) in enumerate(own) if upto >= end - begin)
        plan.append((b.old_shard, b["class"], b.bucket, [{"upto": u, "to": t} for u, t in own[: last + 1]]))
    # at most MAX_BLOCKS rows and a piece more for each flow, so this is small enough to broadcast
    blocks = F.broadcast(spark.createDataFrame(plan, "old_shard int, class int, bucket int, pieces array<struct<upto long, to int>>"))

    order = Window.partitionBy(*block).orderBy(F.desc("size"), "doc_id", "text_crc32")
    ranked = rows.join(blocks, block).withColumn("rank", F.row_number().over(order)).withColumn("middle", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    piece = F.coalesce(F.filter("pieces", lambda p: p["upto"] >= F.col("middle"))[0], F.element_at("pieces", -1))
    placed = written(ranked.withColumn("shard", piece["to"]).drop("pieces", "middle"), "placed")

    counts = placed.groupBy("shard", *block).agg(F.count("*").alias("n"), F.min("rank").alias("first")).orderBy("shard", *block).collect()
    starts, used = [], dict.fromkeys(range(shards), 0)
    for c in counts:
        starts.append((c.shard, c.old_shard, c["class"], c.bucket, used[c.shard] - c["first"]))
        used[c.shard] += c.n
    bases = F.broadcast(spark.createDataFrame(starts, f"shard int, {block[0]} int, {block[1]} int, {block[2]} int, base long"))
    done = placed.join(bases, ["shard", *block])
    return done.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("rank") + F.col("base")).alias("slot"), *(["row"] if carry else []))


def placement_names(columns: list[str]) -> list[str]:
    """Names for the shard and slot of a row that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    return [next(n for k in range(len(columns) + 1) if (n := name + "_" * k) not in taken) for name in ("shard", "slot")]


def rewrite_shards(placed: DataFrame, folder: str, every: bool = False) -> DataFrame:
    """Write the shards that gained or lost rows as ``folder/shard=K``, in slot order; returns their numbers.

    Other shards' files in ``folder`` stay as they are; a shard that lost all its rows loses its files. ``every``
    writes all shards, for rows that are in no shard files yet.
    """
    spark, names = placed.sparkSession, placement_names(placed.schema["row"].dataType.fieldNames())
    gained = placed.where("old_shard <> shard").select("shard")
    lost = placed.where("old_shard <> shard").select(F.col("old_shard").alias("shard"))
    touched = written(gained.union(lost).distinct(), "touched")
    whole = placed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    per_file = max(1, FILE_BYTES * whole.rows // max(whole.bytes or 0, 1))
    chosen = placed if every else placed.join(F.broadcast(touched), "shard")
    files = chosen.select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]), F.floor(F.col("slot") / per_file).alias("_file"))
    files = files.repartition(names[0], "_file").sortWithinPartitions(*names).drop("_file")
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(names[0]).parquet(folder)
    for gone in touched.join(placed.select("shard").distinct(), "shard", "left_anti").collect():  # shards, not rows
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names[0]}={gone.shard}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return touched


def resharded(docs: DataFrame, shards: int = NEW_SHARDS) -> DataFrame:
    """``docs`` dealt to ``shards``, written as shard files and read back: all columns, then shard and slot."""
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "shards")
    placed = reshard(docs, shards)
    rewrite_shards(placed, folder, every=True)
    names = placement_names(docs.columns)
    files = placed.select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
    return spark.read.schema(files.schema).parquet(folder).select(*(F.col(f"`{c}`") for c in files.columns))
