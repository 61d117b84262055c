"""Benchmark decontamination with SimHash windows and a multi-index, in DataFrame operations only.

A document is contaminated by an item if some window of it, as long as the item, has a similarity of at
least 0.8: the weighted Jaccard similarity of their five-word shingles, each weighted by how often it
occurs. Words are what white space separates in the lower-cased text.

1. Shingles that documents share with an item anchor the windows. A window that reaches the similarity
   shares at least 0.8 (w + m) / 1.8 of them, and shifting it right to its first shared shingle loses
   none, so the windows that start at a shared shingle and reach that count include a best one.
2. Each anchored window gets a 64-bit SimHash. Items of its length are looked up by 11 blocks of five or six bits,
   items under each value within one bit of their own: fingerprints within 21 bits are within one bit in at least one
   block, so the index returns all of them.
3. Candidates within the radius are verified by their exact similarity.

At a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3; a pair at the threshold is within 21 bits with
a chance of about 0.9999, closer pairs practically always. Items of fewer than five words have no shingle and match
nothing; so do null and empty texts. A document shorter than the item is one window; a very long one is a row, with as
many windows as it has anchors. Exact copies of a text are searched once. Repeated doc_ids with different texts are texts
of their own; other columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 21
BLOCKS = 11
BROADCAST_BYTES = 64 << 20  # a side of at most so many bytes is broadcast; a larger one is shuffled
TASK_TEXTS = 256  # texts whose windows a task should print and look up


def _checked(df: DataFrame, size: Column | int) -> DataFrame:
    """``df``, a written table whose rows take ``size`` bytes, for the small side of a join."""
    total = df.agg(F.sum(size if isinstance(size, Column) else F.lit(size))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    return F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\f\r"))), r"\s+")


def _shingle(of: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(of, at + k) for k in range(SHINGLE)))


def _shingles(of: Column, start: Column, count: Column) -> Column:
    return F.transform(F.sequence(start, start + count - 1), lambda i: _shingle(of, i))


def simhash(hashes: Column) -> Column:
    """Bit b is one if more than half of ``hashes`` have it; counted four bits at a time in 16-bit lanes of a long."""
    lanes = 0x0001000100010001

    def counted(b: int) -> Column:
        total = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(lanes)))
        bits = F.lit(0).cast("long")
        for k in range(4):
            one = (F.shiftrightunsigned(total, 16 * k).bitwiseAND(F.lit(0xFFFF)) * 2 > F.size(hashes)).cast("long")
            bits = bits.bitwiseOR(F.shiftleft(one, 16 * k + b))
        return bits

    made = counted(0)
    for b in range(1, 16):
        made = made.bitwiseOR(counted(b))
    return made


#: (first bit, bits) of each block
LAID = tuple((64 * k // BLOCKS, 64 * (k + 1) // BLOCKS - 64 * k // BLOCKS) for k in range(BLOCKS))


def _block(fp: Column, k: int) -> Column:
    first, bits = LAID[k]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _blocks(fp: Column, near: bool = False) -> Column:
    """(k, v) of each block; with ``near`` also with each of the block's bits turned."""
    turned = lambda k: [_block(fp, k), *(_block(fp, k).bitwiseXOR(F.lit(1 << j)) for j in range(LAID[k][1]) if near)]
    return F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k in range(BLOCKS) for v in turned(k)))


def _common(a: Column, b: Column) -> Column:
    """Shingles that both have, as often as both have them; counted one by one only where some shingle repeats."""
    count = lambda of, h: F.size(F.filter(of, lambda x: x == h))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h))))


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, m (shingles), hashes and fp of each item that has a shingle."""
    split = benchmark.where("text is not null").select("item_id", words(F.col("text").cast("string")).alias("w"))
    hashed = split.where(F.size("w") >= SHINGLE).select("item_id", (F.size("w") - SHINGLE + 1).alias("m"), _shingles(F.col("w"), F.lit(0), F.size("w") - SHINGLE + 1).alias("hashes"))
    return written(hashed.withColumn("fp", simhash(F.col("hashes"))), "items")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """text_key (XXH64 of the text), item_id, start (word), n_words, differing bits and similarity: the best window
    (most similar, then first) of each contaminated text and item."""
    items = item_table(benchmark)
    need = F.ceil(F.lit(SIMILARITY) * (F.least("m", "n") + F.col("m")) / (1 + SIMILARITY) - 1e-9).cast("int")
    text = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    keyed = text.select(F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n", F.size("w") - SHINGLE + 1)

    anchors = _checked(written(items.select("item_id", "m", F.explode(F.array_distinct("hashes")).alias("h")), "anchors"), 32)
    spread = keyed.select("text_key", "n", "w", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("at"))
    shared = spread.select("text_key", "n", "at", _shingle(F.col("w"), F.col("at")).alias("h")).where("at is not null").join(anchors, "h")
    found = shared.groupBy("text_key", "item_id", "m", "n").agg(F.array_sort(F.collect_set("at")).alias("at"))
    full = found.withColumn("need", need).where(F.size("at") >= F.col("need"))
    starts = F.filter("at", lambda p, j: F.coalesce(F.get("at", j + F.col("need") - 1) <= p + F.col("m") - 1, F.lit(False)))
    begun = full.select("text_key", "m", F.explode(starts).alias("p"), "n").select("text_key", "m", F.greatest(F.lit(0), F.least("p", F.col("n") - F.col("m"))).alias("start"), F.least("m", "n").alias("size"))
    windows = written(begun.groupBy("text_key").agg(F.collect_set(F.struct("start", "size", "m")).alias("windows")), "windows")

    # the texts with windows, once each: keys find them, then only they are dealt, to as many tasks as they need
    keys = windows.select("text_key")
    again = keyed.join(_checked(keys, 16), "text_key", "left_semi").repartition(max(1, -(-windows.count() // TASK_TEXTS)), "text_key").dropDuplicates(["text_key"])
    listed = again.join(windows, "text_key").select("text_key", "w", F.inline("windows"))
    printed = listed.select("text_key", "start", "m", _shingles(F.col("w"), F.col("start"), F.col("size")).alias("hashes")).withColumn("fp", simhash(F.col("hashes")))
    probe = printed.withColumn("block", F.explode(_blocks(F.col("fp")))).select("text_key", "start", "m", "hashes", "fp", "block.k", "block.v")
    index = items.withColumn("block", F.explode(_blocks(F.col("fp"), near=True))).select("item_id", "m", F.col("fp").alias("item_fp"), "block.k", "block.v")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = probe.join(_checked(written(index, "index"), 40), ["m", "k", "v"]).withColumn("differ", F.bit_count(apart)).where(F.col("differ") <= RADIUS)
    # of the blocks in which a pair nearly agrees, the lowest one counts
    for k in range(BLOCKS - 1):
        near = near.where((F.col("k") <= k) | (F.bit_count(_block(apart, k)) > 1))
    paired = near.drop("k", "v").join(_checked(items.select("item_id", F.col("hashes").alias("item_hashes")), F.size("item_hashes") * 8 + 32), "item_id")
    both = _common(F.col("hashes"), F.col("item_hashes"))
    scored = paired.withColumn("both", both).withColumn("similarity", F.col("both") / (F.size("hashes") + F.size("item_hashes") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("text_key", "item_id").agg(F.max_by(F.struct("start", (F.size("hashes") + SHINGLE - 1).alias("n_words"), "differ", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
    return written(best.select("text_key", "item_id", "best.*"), "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id with the best window of each item that contaminates it."""
    found = matches(docs, benchmark)
    keyed = docs.where("text is not null").select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    return keyed.join(_checked(found, 56), "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they are; rows without text stay."""
    found = written(matches(docs, benchmark).select("text_key").distinct(), "contaminated")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").isNull().alias("none"), whole.alias("row"))
    left = named.where("not none").join(_checked(found, 16), "text_key", "left_anti")
    return left.unionByName(named.where("none")).select("row.*")
