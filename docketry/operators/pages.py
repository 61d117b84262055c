"""Pages of a document: which to look at, how relevant each is, and the best one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import relevance

MOST_PAGES = 12


def sampled(pages: DataFrame) -> DataFrame:
    """All pages of documents with up to 12; else 12 spread evenly, rounded half to even."""
    n = F.col("page_count")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(MOST_PAGES - 1)), lambda i: F.least(F.rint(i * (n / float(MOST_PAGES))).cast("int"), n - 1))
    return pages.where((n <= MOST_PAGES) | F.array_contains(wanted, F.col("page_index")))


def scored(pages: DataFrame) -> DataFrame:
    return pages.withColumn("relevance_score", relevance(F.col("text")))


def best(pages: DataFrame) -> DataFrame:
    """doc, page_index and relevance_score of the most relevant page, the first of equals."""
    top = F.max_by(F.struct("page_index", "relevance_score"), F.struct("relevance_score", -F.col("page_index")))
    return pages.groupBy("doc").agg(top.alias("p")).select("doc", "p.*")
