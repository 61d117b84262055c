"""Match rules and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.similarity import partial_reaches, token_set_ratio
from docketry.sources.shared import written

TOLERANCE = 0.05


def _null_rule(predicted: Column, truth: Column, rule: Column) -> Column:
    return F.when(truth.isNull(), predicted.isNull()).when(predicted.isNull(), False).otherwise(F.coalesce(rule, F.lit(False)))


def match_numeric(predicted: Column, truth: Column, tolerance: float = TOLERANCE) -> Column:
    return _null_rule(predicted, truth, F.when(truth == 0, predicted == 0).otherwise(F.abs(predicted - truth) / F.abs(truth) <= tolerance))


def match_dealer(predicted: Column, truth: Column, least: float = 90) -> Column:
    p, g = T.evaluation_key(predicted), T.evaluation_key(truth)
    long_enough = F.char_length(p) >= F.greatest(F.lit(8), F.floor(F.char_length(g) / 2))
    return _null_rule(predicted, truth, (token_set_ratio(p, g) >= least) | (long_enough & partial_reaches(p, g, 95)))


def match_model_plain(predicted: Column, truth: Column) -> Column:
    """The rules that need no similarity: equal keys, or shared numbers with a shared word."""
    p, g = T.match_key(predicted), T.match_key(truth)
    numbers = F.regexp_extract_all(g, F.lit("[0-9]+"), F.lit(0))
    words = lambda t: F.filter(F.split(t, " "), lambda w: w.rlike(r"^\p{L}{3,}$"))
    overlap = F.arrays_overlap(words(p), words(g))
    every = (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(p, n))
    some = F.exists(numbers, lambda n: (F.char_length(n) >= 3) & F.contains(p, n))
    return _null_rule(predicted, truth, (p != "") & (g != "") & ((p == g) | (overlap & (every | some))))


def match_model(predicted: Column, truth: Column) -> Column:
    p, g = T.match_key(predicted), T.match_key(truth)
    words = lambda t: F.filter(F.split(t, " "), lambda w: w.rlike(r"^\p{L}{3,}$"))
    alike = F.arrays_overlap(words(p), words(g)) & ((token_set_ratio(p, g) >= 60) | partial_reaches(p, g, 80))
    return match_model_plain(predicted, truth) | _null_rule(predicted, truth, alike & (p != "") & (g != ""))


SIX = ("dealer_name", "model_name", "horse_power", "asset_cost", "signature", "stamp")


def score_documents(labels: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, error and a boolean for each of the six fields, of the labelled documents.

    ``labels``: doc_id, the four values, signature_present and stamp_present; rows without a doc_id are skipped.
    ``results``: flat results (``assemble.legacy``). A document without a result has the error ``missing`` and no hit.
    """
    truth = labels.where("doc_id is not null and doc_id <> ''").select("doc_id", *(F.col(c).alias(f"true_{c}") for c in (*SIX[:4], "signature_present", "stamp_present")))
    rows = truth.join(results.withColumn("_there", F.lit(True)), "doc_id", "left")
    is_there = F.col("_there").isNotNull()
    rules = {
        "dealer_name": match_dealer(F.col("dealer_name"), F.col("true_dealer_name")),
        "model_name": match_model(F.col("model_name"), F.col("true_model_name")),
        **{c: match_numeric(F.col(c), F.col(f"true_{c}")) for c in SIX[2:4]},
        **{c: F.coalesce(f"{c}_present", F.lit(False)) == F.coalesce(f"true_{c}_present", F.lit(False)) for c in SIX[4:]},
    }
    return rows.select("doc_id", F.when(is_there, F.col("error")).otherwise("missing").alias("error"), *((is_there & rule).alias(f"{c}_hit") for c, rule in rules.items()), *(F.coalesce(f"{c}_present", F.lit(False)).alias(f"{c}_got") for c in SIX[4:]), *(F.coalesce(f"true_{c}_present", F.lit(False)).alias(f"{c}_true") for c in SIX[4:]), F.col("processing_time_sec").alias("seconds"))


def report(scored: DataFrame) -> DataFrame:
    """One row: totals, share of documents with all six fields, accuracy by field, confusion of the visual fields, latencies."""
    return report_of(report_sums(scored), latency(scored, "seconds"))


def report_sums(scored: DataFrame) -> DataFrame:
    """The counts of a report, one row; counts of parts add up to those of the whole."""
    every = F.lit(True)
    for c in SIX:
        every = every & F.col(f"{c}_hit")
    counts = [F.count_if(F.col(f"{c}_hit")).alias(f"{c}_correct") for c in SIX]
    tables = [F.count_if(p & t).alias(f"{c}_{n}") for c in SIX[4:] for n, p, t in (("tp", F.col(f"{c}_got"), F.col(f"{c}_true")), ("fp", F.col(f"{c}_got"), ~F.col(f"{c}_true")), ("tn", ~F.col(f"{c}_got"), ~F.col(f"{c}_true")), ("fn", ~F.col(f"{c}_got"), F.col(f"{c}_true")))]
    return scored.agg(F.count("*").alias("docs_total"), F.count_if(every).alias("docs_correct"), F.count_if(F.col("error").isNotNull()).alias("errors"), *counts, *tables)


def report_of(sums: DataFrame, latencies: DataFrame) -> DataFrame:
    """The report of a row of counts and one of latencies."""
    dla = F.coalesce(F.try_divide("docs_correct", "docs_total"), F.lit(0.0)).alias("dla")
    accuracy = [F.coalesce(F.try_divide(f"{c}_correct", "docs_total"), F.lit(0.0)).alias(f"{c}_accuracy") for c in SIX]
    times = latencies.select(*(F.col(c).alias(f"seconds_{c}") for c in ("p50", "p95", "max")))
    return sums.select("*", dla, *accuracy).join(times, F.lit(True), "left")


def report_summary(report: DataFrame) -> DataFrame:
    """field, correct, total and accuracy lines of a report, as its reader shows them."""
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.concat_ws("/", f"{c}_correct", "docs_total").alias("shown"), F.col(f"{c}_accuracy").alias("accuracy")) for c in SIX))
    return report.select(F.inline(rows))


def field_accuracy(scored: DataFrame, hits: list[str]) -> DataFrame:
    """field, correct, total and accuracy of boolean columns, and the share of rows with all of them."""
    every = F.lit(True)
    for h in hits:
        every = every & F.col(h)
    pairs = [*((h, F.col(h)) for h in hits), ("document", every)]
    sums = scored.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("correct")) for n, _ in pairs)))
    return sums.select("total", rows.alias("r")).select("r.field", "r.correct", "total", F.coalesce(F.try_divide("r.correct", "total"), F.lit(0.0)).alias("accuracy"))


def confusion(scored: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    return scored.agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & ~truth).alias("tn"), F.count_if(~predicted & truth).alias("fn"))


def latency(rows: DataFrame, value: str) -> DataFrame:
    """n, p50 (the median), p95 (the value at rank int(0.95 n), counted from 0) and max, without gathering the values."""
    return latency_of(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))


def latency_of(counts: DataFrame) -> DataFrame:
    """``latency`` of a table of values ``v`` and their counts ``c``."""
    n = F.col("n")
    wanted = {"p95": F.least(F.floor(n * 0.95), n - 1), "low": F.floor((n - 1) / 2), "high": F.floor(n / 2)}
    found = values_at(counts, wanted)
    picked = found.agg(*(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max("v").alias("max"))
    return sums.join(picked, F.lit(True)).select("n", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "max")


def values_at(counts: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """name and v, the value at each of ``ranks`` (from 0, in terms of the number ``n`` of values), of a table of distinct
    values ``v`` and counts ``c``.

    Values are dealt to bands by sampled quantiles. Prefix sums over the bands find that of a rank, and those inside it its
    value, so no task sorts more than a band, however the values lie.
    """
    parts = max(8, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bands = written(counts.repartitionByRange(parts, "v").withColumn("band", F.spark_partition_id()), "bands")
    sums = bands.groupBy("band").agg(F.sum("c").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("band")) - F.col("s"))  # a row for each band
    asked = sums.agg(F.sum("s").alias("n")).select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()))))
    at = before.join(F.broadcast(asked), (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("s"))).select("band", "before", "name", "rank")
    inner = bands.join(F.broadcast(at), "band").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("name").orderBy("v")))
    return inner.where("upto > rank").groupBy("name").agg(F.min("v").alias("v"))


def hit_histogram(scored: DataFrame, hits: list[str]) -> DataFrame:
    return scored.groupBy(sum((F.col(h).cast("int") for h in hits), F.lit(0)).alias("hits")).agg(F.count("*").alias("docs"))
