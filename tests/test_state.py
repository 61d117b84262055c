"""Streams with state: documents in parts, and the report that grows, against the batch forms; replays."""

import datetime as dt
import random

from docketry.operators import evaluate
from docketry.streaming.documents import extract_batch
from docketry.streaming.parts import PART, part_stream, run_documents, statuses
from docketry.streaming.report import add_batch, report_after, run_report


def tokens(words, first=0):
    return [(first + k, w, 60 + 110 * k, 100, 160 + 110 * k, 120, 0.95) for k, w in enumerate(words.split())]


def test_documents_in_parts(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    cost = tokens("Grand Total : 525000")
    batches = [
        [("a", 0, 2, at(0), cost[:2]), ("b", None, None, at(0), []), ("c", 0, 3, at(0), tokens("lost")), ("e", 0, 1, at(0), [])],
        [("a", 0, 2, at(1), cost[:2]), ("b", 1, 2, at(1), tokens("HP", 1)), ("d", 0, 1, at(1), tokens("60 HP"))],
        [("a", 1, 2, at(2), cost[2:]), ("a", 0, 2, at(2), tokens("Grand Total : 999999")), ("b", 0, 2, at(2), tokens("50"))],
        [("a", 1, 2, at(3), tokens("Grand Total : 111111")), ("d", 0, 1, at(3), tokens("99 HP")), (None, 0, 1, at(3), [])],
        [("x", 0, 1, at(300), tokens("x"))],
        [("y", 0, 1, at(301), tokens("y"))],
    ]
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    seen = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PART).coalesce(1).write.mode("append").parquet(source)
        run_documents(part_stream(spark, source, 1), target, checkpoint).awaitTermination()
        seen[k] = {r.doc_id: r.status for r in statuses(spark, target).collect()}
    assert [seen[k]["a"] for k in range(4)] == ["processing", "processing", "completed", "completed"]
    assert [seen[k]["b"] for k in range(3)] == ["queued", "processing", "completed"]
    assert seen[0]["e"] == "completed" and seen[3]["c"] == "processing" and seen[5]["c"] == "failed" and seen[5]["d"] == "completed"
    results = spark.read.parquet(f"{target}/results").collect()
    assert sorted(r.doc_id for r in results) == ["a", "b", "d", "e", "x", "y"]  # one result each
    got = {r.doc_id: (r.horse_power and r.horse_power.value, r.asset_cost and r.asset_cost.value) for r in results}
    assert got["a"] == (None, 525000) and got["b"] == (50, None) and got["d"] == (60, None) and got["e"] == (None, None)
    # the same documents at once, as one batch
    whole = spark.createDataFrame([("a", *t) for t in cost] + [("b", *t) for t in tokens("50 HP")], "doc_id string, tok_idx int, text string, x1 int, y1 int, x2 int, y2 int, conf double")
    assert {r.doc_id: (r.horse_power and r.horse_power.value, r.asset_cost and r.asset_cost.value) for r in extract_batch(whole).collect()} == {d: got[d] for d in "ab"}
    # nothing new: nothing changes
    before = sorted(map(str, spark.read.parquet(f"{target}/changes").collect()))
    run_documents(part_stream(spark, source, 1), target, checkpoint).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{target}/changes").collect())) == before


LABELS = "doc_id string, dealer_name string, model_name string, horse_power int, asset_cost long, signature_present boolean, stamp_present boolean"
RESULTS = f"{LABELS}, error string, processing_time_sec double"


def test_report_grows_with_the_documents(spark, tmp_path):
    rng = random.Random(3)
    labels, results = [], []
    for i in range(60):
        truth = (f"d{i}", "Nimar Motors", "Mahindra 575 DI", 50, 500_000 + i, rng.random() < 0.5, rng.random() < 0.5)
        labels.append(truth)
        results.append((f"d{i}", rng.choice(["Nimar Motors", "Other"]), rng.choice(["mahindra 575", None]), rng.choice([50, 70]), 500_000 + i, rng.random() < 0.5, True, rng.choice([None, "corrupt_input: x"]), rng.choice([0.5, 1.5, 2.0, 1e300])))
    truth, source, target = spark.createDataFrame(labels, LABELS), str(tmp_path / "in"), str(tmp_path / "report")
    stream = lambda: spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(source)
    for k in range(3):
        spark.createDataFrame(results[20 * k : 20 * (k + 1)], RESULTS).coalesce(1).write.mode("append").parquet(source)
        run_report(stream(), truth, target, str(tmp_path / "cp")).awaitTermination()
        so_far = spark.createDataFrame(results[: 20 * (k + 1)], RESULTS)
        mine = truth.join(so_far.select("doc_id"), "doc_id", "left_semi")
        assert report_after(spark, target).first() == evaluate.report(evaluate.score_documents(mine, so_far)).first()
    first = [report_after(spark, target, k).first() for k in range(3)]
    for k in (1, 2, 1):  # a batch that runs again changes nothing
        part = spark.createDataFrame(results[20 * k : 20 * (k + 1)], RESULTS)
        add_batch(evaluate.score_documents(truth.join(part.select("doc_id"), "doc_id", "left_semi"), part), k, target)
    assert [report_after(spark, target, k).first() for k in range(3)] == first and first[2].docs_total == 60


def test_latency_with_outliers(spark):
    values = [float(i % 97) for i in range(1000)] + [1e300, -1e300, float("inf")]
    got = evaluate.latency(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
    ordered = sorted(values)
    assert (got.n, got.p50, got.p95, got.max) == (1003, ordered[501], ordered[int(0.95 * 1003)], ordered[-1])
    assert evaluate.latency(spark.createDataFrame([], "v double"), "v").first().n == 0
