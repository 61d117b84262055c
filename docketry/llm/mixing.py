"""Mixing documents to target domain weights under soft membership.

A classifier fitted on a bounded sample of labelled documents gives every document a posterior over
domains. Its rate r >= 0 says how often it is to be used. With n tokens and posterior p, domain d is
expected to get T_d(r) = sum n r p_d tokens; the rates minimise sum (T_d(r) - t_d)^2 / T_d(1) by
projected gradient steps r <- max(0, r - sum_d p_d (T_d(r) - t_d) / T_d(1)), from r = 1. In the metric
that weighs documents by their tokens the Hessian's largest eigenvalue is 1, so the full step is safe and
a document's rate does not depend on its length. A step costs one aggregation of as many numbers as
domains; rates live in the cluster only.

``total`` says how many tokens the mixture is to have; ``CORPUS`` means as many as the documents have. By default
the total is the least for which no domain shrinks, so all documents stay and scarce domains repeat. ``residual``
says how far the worst domain's expected tokens are from its target, as a share of it (for a target of zero, of all
targets): above ``CLOSE`` no rates meet the targets, or the steps did not suffice. ``copies`` turns a rate into whole
copies by a hash of doc_id.

A domain that no labelled row has cannot be told apart; its weight is shared among the others. Without
labelled rows all rates are 1. Null and empty texts have no tokens and rate 1.
A null doc_id hashes like any value; repeated rows are mixed alike. Labels repeated for a doc_id are one.
Other columns are carried along. Texts are read whole, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import vec
from docketry.llm.common import bounded_sample, written
from docketry.llm.features import STATS, Linear, Problem, bag, fit, softmax, token_buckets
from docketry.llm.quality import once

LABELLED = 10_000  # labelled documents that the classifier is fitted on at most
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
STEPS = 60
PASSES = 16  # over the features of the labelled documents
CLOSE = 1e-4  # largest relative distance to a target at which the steps end
KEEP = 8  # steps between written rates
CORPUS = -1.0  # as ``total``: the documents' own tokens


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], labelled: int = LABELLED) -> tuple[Linear | None, list[str]]:
    """A classifier of ``docs.lang`` from documents that ``labels`` calls good and not toxic, and the domains that it has seen."""
    trusted = labels.where("doc_id is not null and quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isin(domains)).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("lang")).cast("int") - 1
    chosen = written(bounded_sample(ids.join(trusted, "doc_id"), "doc_id", labelled).select("doc_id", number.alias("domain")), "labelled")
    seen = sorted(r.domain for r in chosen.select("domain").distinct().collect())  # domains, not documents
    if not seen:
        return None, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, stats = bag(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary()), batch.column("domain")], ["keys", "counts", "stats", "domain"])

    numbered = chosen.withColumn("domain", F.array_position(F.array(*map(F.lit, seen)), F.col("domain")).cast("int") - 1)
    rows = once(docs, numbered, F.col("text").cast("string").alias("text")).select("text", "domain")
    table = written(rows.mapInArrow(run, "keys binary, counts binary, stats binary, domain int"), "features")
    problem = Problem("domain", len(seen), "stats", STATS, True, 1e-3)
    return fit(table, [problem], [Linear(len(seen), STATS, True)], PASSES)[0], [domains[k] for k in seen]


def posteriors(docs: DataFrame, model: Linear | None, domains: int) -> DataFrame:
    """doc_id, n_tokens and posterior (array of double) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.flat(batch.column(1))
            p, n = np.full((batch.num_rows, domains), 1 / domains), np.zeros(batch.num_rows, np.int64)
            for a, b in vec.pieces(offsets, 1 << 21):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                n[a:b] = np.diff(vec.Words(part, at).rows)
                if model is not None:
                    p[a:b] = softmax(model.score_tokens(*token_buckets(part, at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens long, posterior array<double>")


def distance(have: list[float], targets: list[float]) -> float:
    """The largest distance to a target, as a share of it; for a target of zero, of all targets."""
    whole = max(sum(targets), 1.0)
    return max((abs(h - t) / t if t else h / whole for h, t in zip(have, targets, strict=True)), default=0.0)


def solve(members: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """``members`` (…, n_tokens, posterior) with ``rate`` and ``residual``. ``targets``: tokens of each domain."""
    now = members.withColumn("rate", F.lit(1.0))
    base = have = expected(now, len(targets))
    for step in range(1, steps + 1):
        if distance(have, targets) <= close or not sum(base):
            break
        slope = [(h - t) / b if b else 0.0 for h, t, b in zip(have, targets, base, strict=True)]
        move = sum((F.col("posterior")[d] * F.lit(s) for d, s in enumerate(slope)), F.lit(0.0))
        now = now.withColumn("rate", F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.0), F.col("rate") - move)).otherwise(1.0))
        if step % KEEP == 0:
            now = written(now, "rates")
        have = expected(now, len(targets))
    return now.withColumn("residual", F.lit(distance(have, targets) if sum(base) else 0.0))


def expected(rated: DataFrame, domains: int) -> list[float]:
    """Expected tokens of each domain at the rates of ``rated``."""
    return [float(x or 0) for x in rated.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[d]) for d in range(domains))).first()]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, residual and copies of every row of ``docs`` (doc_id, text, lang)."""
    weights = weights or TARGETS
    model, seen = fit_domains(docs, labels, list(weights))
    members = written(posteriors(docs, model, max(len(seen), 1)), "posteriors")
    asked = [weights[d] for d in seen] or [1.0]
    asked = [w / (sum(asked) or 1.0) for w in asked]
    base = expected(members.withColumn("rate", F.lit(1.0)), len(asked))
    if total is None:
        total = (1 + 2 * CLOSE) * max([h / w for h, w in zip(base, asked, strict=True) if w > 0] or [0.0])
    elif total == CORPUS:
        total = sum(base)
    return with_copies(solve(members, [total * w for w in asked], STEPS if seen else 0))


def with_copies(rated: DataFrame) -> DataFrame:
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies say, all columns as they are.

    Rows that repeat a doc_id get the copies of the longest of them.
    """
    rates = mix(docs, labels, weights).groupBy("doc_id").agg(F.max_by("copies", "n_tokens").alias("_copies")).withColumnRenamed("doc_id", "_other")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    joined = docs.select(F.col("doc_id").alias("_doc"), whole).join(rates, F.col("_doc").eqNullSafe(F.col("_other")))
    return joined.withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")
