"""Distributed connected components by repeated contraction.

Each round points every node at the smallest of itself and its neighbours (a partial aggregation, so a
hub costs one row a task), renames the edges by it and drops those that fell together. A component at
least halves its nodes a round, so rounds grow with the logarithm of the largest component at most.
Every round's tables are written to the shared folder; neither links nor components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the smallest node it reaches.

    Nulls, loops and repeated edges have no effect. Nodes without an edge are not returned.
    """
    live = _clean(edges.select("a", "b"))
    live = written(live, "edges")
    found = None
    while not live.isEmpty():
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "parents")
        if found is None:
            found = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = found.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        left = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = written(_clean(live.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(found, "components")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
