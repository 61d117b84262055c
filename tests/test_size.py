"""What keeps the queries' figures from growing faster than their input."""

import re
import sys

import numpy as np

from docketry.operators import anchors, detections
from docketry.plans import surrogates
from docketry.plans.queries import QUERIES
from docketry.sources import images, shared

SMALL = "/root/testdata/sf0.001"


def test_overlaps_are_not_broadcast(spark, monkeypatch):
    plans = []

    def noted(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.written(df, what)

    monkeypatch.setattr(detections, "written", noted)
    rows = [(1, k, 10 * (k % 4), 0, 10 * (k % 4) + 40, 30, 0.5) for k in range(12)]
    boxes = spark.createDataFrame(rows, "doc_id long, seq long, x1 int, y1 int, x2 int, y2 int, conf double")
    assert sorted(r.seq for r in detections.keep_first(boxes).collect()) == [0, 1, 2, 3]
    assert len(plans) >= 3 and not any("BroadcastExchange" in p for p in plans)


def test_tokens_stay_with_their_document(spark):
    plan = QUERIES["normalize_cross_field"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning(doc_id")  # what comes later lies deeper


def test_token_code_is_short_enough_to_be_compiled(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show no code
    try:
        for name in ("normalize_cross_field", "hp_candidates", "cost_candidates", "dealer_harvest", "model_best"):
            code = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, SMALL)._jdf.queryExecution(), "codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
            assert sizes and max(sizes) < 8000, name  # the JVM interprets longer methods
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_small_images_are_decoded_in_runs():
    rng = np.random.default_rng(3)
    flat = np.full((100, 140, 3), 255, np.uint8)
    flat[12:40, 20:50] = (30, 40, 160)
    for step, plain in [(3, flat.reshape(100, -1))] + [(s, rng.integers(0, top, (20, 12 * s)).astype(np.uint8)) for s in (1, 2, 3, 4, 6, 8) for top in (2, 4, 256)]:
        height, line = plain.shape
        for kind in range(5):  # each filter by its definition
            wide = np.zeros((height + 1, line + step), int)
            wide[1:, step:] = plain
            left, up, corner = wide[1:, :-step], wide[:-1, step:], wide[:-1, :-step]
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = (0 * left, left, up, (left + up) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)))[kind]
            assert (images.unfiltered(((plain - guess) & 255).astype(np.uint8), np.full(height, kind), step) == plain).all(), (step, kind)
    page, lines = images.as_png(flat), 0

    def trace(frame, event, _):
        nonlocal lines
        lines += event == "line" and frame.f_code.co_filename == images.__file__
        return trace

    sys.settrace(trace)
    try:
        assert (images.png(page) == flat).all()
    finally:
        sys.settrace(None)
    assert lines < flat.size / 2  # a byte is not a step


def test_each_word_is_repaired_once(spark):
    plan = QUERIES["digit_repair"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2 and plan.rindex("SortAggregate") < plan.index("hashpartitioning(w") < plan.index("Generate explode")


def test_each_label_line_is_split_once(spark):
    plan = QUERIES["issue_head"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # for the first issues and for the number of all


def test_tokens_are_made_by_compiled_code(spark):
    plan = surrogates.quote_tokens(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "posexplode" in plan


def test_only_where_a_name_begins_is_looked_ahead(spark):
    for name in ("dealer_harvest", "model_best"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        looks = plan.index("[lead(me")
        assert plan.rindex("begins", 0, looks) > 0 and plan.index("Filter (_near", looks) > 0, name


def test_letterhead_steps_are_not_repeated_in_a_filter(spark):
    plan = QUERIES["dealer_best"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("lambda") for line in plan.split("\n") if " Filter " in line) < 50


def test_candidates_are_made_by_compiled_generators(spark):
    for name in ("cost_candidates", "hp_candidates"):
        lines = [line for line in QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "SQRT" in line]
        assert lines and all("Generate" in line and "lambda" not in line for line in lines), name


def test_words_that_hold_a_sign_by_chance_are_not_looked_at(spark):
    texts = ["TRACTORS", "Horse", "inrush", "Rs", "rs.", "Rs.5", "(INR)", "₹5", "subtotal", "12"]
    rows = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "doc_id long, tok_idx int, text string")
    seen = anchors.with_signs(rows, "asset_cost").orderBy("tok_idx").collect()
    assert [r.text for r in seen if r.sign_asset_cost] == ["Rs", "rs.", "Rs.5", "(INR)", "₹5", "subtotal"]


def test_best_fields_are_a_maximum_of_compiled_rows(spark):
    lines = [line for line in QUERIES["eval_histogram"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "SQRT" in line]
    assert lines and all("Generate" in line and "lambda" not in line for line in lines)  # and not in the aggregation


def test_sure_documents_read_tokens_without_their_text(spark):
    """tokens are made for names, letterheads and numbers; full texts, which nobody asks for, need no pass of their own."""
    from docketry.plans.pipeline import tier_one

    made = lambda df: len(re.findall(r"Generate posexplode\(", df._jdf.queryExecution().optimizedPlan().toString()))
    with_text = tier_one(surrogates.quote_tokens(spark, SMALL), ["Mahindra", "Sonalika"])
    assert "full_text" in with_text.columns
    assert made(QUERIES["sure_documents"](spark, SMALL)) == made(with_text) - 1 > 0
