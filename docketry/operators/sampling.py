"""Stratified and uniform samples and splits: by rank, so sizes are exact and members are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.sources.shared import written


def ranked(df: DataFrame, order: list[Column], group: Column | None = None) -> DataFrame:
    """``df`` with ``_rank``, the place of a row in ``order`` (from 1) within its ``group`` or over all rows.

    Rows are dealt to tasks by ranges of (group, order), so a large group is spread over many; ranks within a range go on
    where the ranges before it ended in that group.
    """
    keyed = df.withColumn("_g", group if group is not None else F.lit(0)).withColumns({f"_o{k}": c for k, c in enumerate(order)})
    by = ["_g", *(f"_o{k}" for k in range(len(order)))]
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = written(keyed.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_g", "_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_n")).drop("_n")  # a row for each range and group in it
    inner = F.row_number().over(Window.partitionBy("_p", "_g").orderBy(*by[1:]))
    met = ranges.withColumn("_i", inner).join(before.withColumnsRenamed({"_g": "_h", "_p": "_q"}), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q")))
    return met.withColumn("_rank", F.col("_i") + F.col("_before")).select(*df.columns, "_rank")


def stratified(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """From each group its share of ``n``, rounded half to even, one at least; first in ``order``. Rows without a group are one."""
    sizes = written(df.groupBy(F.col(group).alias("_h")).agg(F.count("*").alias("_size")), "sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 1
    share = F.greatest(F.lit(1), F.rint(F.lit(float(n)) * F.col("_size") / F.lit(total)).cast("int"))
    met = ranked(df, order, F.col(group)).join(sizes, F.col(group).eqNullSafe(F.col("_h")))
    return met.where(F.col("_rank") <= share).select(*df.columns)


def split(df: DataFrame, order: list[Column], parts: dict[str, float]) -> DataFrame:
    """``df`` with ``part``: the first rounded share of rows in ``order``, then the next; the last part takes the rest."""
    total, upto, label = df.count(), 0, F.lit(list(parts)[-1])
    cuts = []
    for name in list(parts)[:-1]:
        upto += round(total * parts[name])
        cuts.append((upto, name))
    for cut, name in reversed(cuts):
        label = F.when(F.col("_rank") <= cut, name).otherwise(label)
    return ranked(df, order).withColumn("part", label).drop("_rank")


def uniform(df: DataFrame, key: str, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """``n`` rows, the first in ``order``, by default that of a hash of ``key`` and ``seed``."""
    return df.orderBy(order if order is not None else F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")
