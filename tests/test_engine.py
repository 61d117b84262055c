"""Text, geometry and similarity functions and the extraction operators on small token fixtures."""

import collections
import json
import random
import statistics
import uuid

import pytest
from docketry.functions import geometry as G
from docketry.functions import similarity, text
from docketry.operators import assemble, detections, evaluate, masters, normalize, numeric_fields, sampling, store, text_fields
from pyspark.sql import functions as F


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def page(spark, *docs):
    """Token tables from lists of (text, x, y[, conf])."""
    rows = [(d, i, t[0], t[1], t[2], t[1] + 100, t[2] + 20, t[3] if len(t) > 3 else 0.95) for d, ts in enumerate(docs) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "doc_id long, tok_idx int, text string, x1 int, y1 int, x2 int, y2 int, conf double")


def line(words, y=100):
    return [(w, 60 + 110 * k, y) for k, w in enumerate(words.split())]


def best(candidates):
    return {r.doc_id: r for r in numeric_fields.best(candidates).collect()}


def test_numbers(spark):
    assert column(spark, ["5,25,000", "Rs. 5,25,000", "525000.00", "", None, "५०"], text.to_int) == [525000, 525000, 52500000, None, None, 50]
    assert column(spark, [0.0, 80.0, 300.0, 500.0], text.proximity, "double") == [1.0, 1.0, 0.55, 0.55]
    assert column(spark, [50, 200, 120, 11], lambda v: text.sanity(v, 15, 150), "int") == [1.0, 0.0, 1.0, 0.5]
    assert column(spark, ["YUVO 405 DI (HP-39)", "405 D1 HP. 39!", "MF 245 DI 50 HP", "3805P+ 40HP", "PT-439", None, "HP 7 999HP"], text.hp_from_text) == [39, 39, 50, 40, None, None, None]


def test_texts(spark):
    assert column(spark, ["  MAHINDRA  575-DI  ", "एचपी!", None], text.match_key) == ["mahindra 575 di", "एचप", None]
    assert column(spark, ["abc", "एचपी", "કુલ", "एકુ"], text.script) == ["en", "hi", "gu", "mixed"]
    assert column(spark, ["2q", "qq", "S0"], text.digit_repair) == ["29", "qq", "50"] and column(spark, ["qq"], text.digit_repair_loose) == ["99"]
    assert column(spark, [None, 0, 999, 1000, 525000, 12345678], text.inr, "bigint") == ["—", "₹0", "₹999", "₹1,000", "₹5,25,000", "₹1,23,45,678"]
    assert column(spark, ['x {"a": "}"} y', "no", '{"a": 1}} z', '{"a": 1} {', None, "{1}"], text.json_blob) == ['{"a": "}"}', None, None, '{"a": 1}', None, None]
    assert column(spark, ["", None, "Grand Total total 123456"], text.relevance) == pytest.approx([0.0, 0.0, 2.0 * 1.4 + 3.0 + 0.5])
    assert column(spark, [-0.5, 0.5, 2.0, None], text.unit, "double") == [0.0, 0.5, 1.0, None]


def test_model_answers(spark):
    assert column(spark, ["true", "52", "52.9", '"Rs. 5,25,000"', "null", None, "[1]"], text.coerce_int) == [None, 52, 52, 525000, None, None, None]
    assert column(spark, ["₹5,25,000", "Rs. 12", "12 lakh", ""], text.manual_int) == [525000, 12, None, None]
    assert column(spark, [512, 2048, 5 * 1024**3], text.human_size, "bigint") == ["512.0 B", "2.0 KB", "5.0 GB"]
    asked = spark.createDataFrame([("page", ["stamp", "asset_cost", "dealer_name"])], "t string, f array<string>").select(text.prompt(F.col("t"), F.col("f")).alias("x")).first().x
    assert asked.endswith('["asset_cost","dealer_name"]') and "page" in asked


def test_boxes(spark):
    rows = spark.sql("select named_struct('x1', 0, 'y1', 0, 'x2', 10, 'y2', 10) a, named_struct('x1', 5, 'y1', 5, 'x2', 15, 'y2', 15) b")
    r = rows.select(G.iou(F.col("a"), F.col("b")).alias("iou"), G.distance(F.col("a"), F.col("b")).alias("d"), G.same_row(F.col("a"), F.col("b")).alias("row"), G.well_formed(F.col("a")).alias("ok")).first()
    assert (round(r.iou, 6), r.d, r.row, r.ok) == (round(25 / 175, 6), 7.0, True, True)
    quad = spark.sql("select array(named_struct('x', -1.5D, 'y', 2.5D), named_struct('x', 9.5D, 'y', 7.0D)) q").select(G.quad_box(F.col("q")).alias("b")).first().b
    assert tuple(quad) == (0, 2, 10, 7)


def test_similarity():
    assert similarity.token_set("MADHU PAWAN AUTOMOBILES", "MADHU PAVAN AUTOMOBILES") == pytest.approx(95.652174)
    assert similarity.token_set("a b", "a b c") == 100 and similarity.token_set("", "a") == 0
    assert similarity.partial("abc", "xxabcyy") == 100 and similarity.ratio("abcd", "abxd") == 75


def test_partial_and_token_set_columns(spark):
    rng, rows = random.Random(1), [("", ""), ("", "a"), ("x" * 70 + "yz", "q" * 30 + "x" * 69 + "yzw"), ("aab", "aaab"), (r"a\\Eb", r"zz a\\Eb z")]
    for _ in range(500):
        letters = rng.choice(["ab", "abc ", "abcdefgh ij"])
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, most))) for most in (14, 40))
        if rng.random() < 0.6 and len(a) > 2:
            k, at = rng.randrange(len(a)), rng.randint(0, len(b))
            b = b[:at] + a[:k] + rng.choice(["", "z", a[k]]) + a[k + 1 :] + b[at:]
        rows.append((a, b))
    table = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "a string, b string")
    for least in (60, 80, 85, 95):
        got = table.select("a", "b", similarity.partial_reaches(F.col("a"), F.col("b"), least).alias("p"), similarity.token_set_ratio(F.col("a"), F.col("b")).alias("t")).collect()
        for r in got:
            known = r.a is not None and r.b is not None
            assert r.p == (similarity.partial(r.a, r.b) >= least if known else None) and r.t == (similarity.token_set(r.a, r.b) if known else None)
    plan = table.where(similarity.partial_reaches(F.col("a"), F.col("b"), 85))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_similarity_columns(spark):
    """The column forms against the plain ones, and repeated words against a plain loop."""
    rng = random.Random(12)
    words = ["", "a", "ab", "मोटर", "x" * 70, "y" + "x" * 69, *("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(60))]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(300)] + [("x" * 70, "y" + "x" * 69)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.letters_in_common(F.col("a"), F.col("b")).alias("n"), similarity.resembles(F.col("a"), F.col("b"), 80).alias("r")).collect()
    assert all(r.n == similarity.common(r.a, r.b) and r.r == (similarity.ratio(r.a, r.b) >= 80) for r in rows)

    def tails(w):
        while k := next((k for k in range(len(w) // 2, 0, -1) if w[-k:] == w[-2 * k : -k]), 0):
            w = w[:-k]
        return w

    def echoes(w):
        while len(w) > 1:
            w = tails(w)
            p = [x.lower().strip(".,:;-") for x in w]
            if len(w) < 2 or not p[-1] or not any(x and similarity.ratio(p[-1], x) >= 80 for x in p[:-1]):
                break
            w = w[:-1]
        return w

    lists = [["A", "B", "C", "A", "B", "C"], ["XYZ", "LTD", "LtD"], ["one"], [], ["-", "-"], ["a", "a", "a", "b", "a", "a", "b"], ["SONS", "Motors", "Motor.", "MOTORS"], *([rng.choice(["A", "B", "Motors", "MOTOR", "ltd", "."]) for _ in range(rng.randint(1, 9))] for _ in range(120))]
    rows = spark.createDataFrame([(w,) for w in lists], "w array<string>").select("w", similarity.without_repeated_tail(F.col("w")).alias("t"), similarity.without_echoes(F.col("w")).alias("e")).collect()
    assert all(r.t == tails(r.w) and r.e == echoes(r.w) for r in rows)
    assert column(spark, ["575 DI HP. !39", "! - x", "", "DI 575 एचपी (39)", "Sonalika 35"], text_fields.strip_trailers) == ["575 DI", "", "", "DI 575", "Sonalika 35"]


def test_horse_power(spark):
    docs = [line("Horse Power : 50 HP"), line("Model 50HP"), line("75 एचपी"), [("HP", 60, 100), ("50", 170, 100, 0.6), ("HP", 60, 400), ("75", 170, 400)], line("nothing here"), line("HP 2q")]
    got = best(numeric_fields.horse_power_candidates(page(spark, *docs)))
    assert {k: v.value for k, v in got.items()} == {0: 50, 1: 50, 2: 75, 3: 75, 5: 29}
    assert got[0].confidence > 0.55 and got[0].source == "tier1"


def test_asset_cost(spark):
    docs = [line("Total Cost : Rs. 5,25,000"), [*line("Total 100000", 100), *line("Grand Total 525000", 900)], [*line("x", 10), *line("6,80,000", 900)], [*line("x", 10), *line("250000", 700), *line("300000", 900), *line("9876543", 950)], line("none")]
    got = best(numeric_fields.asset_cost_candidates(page(spark, *docs)))
    assert {k: v.value for k, v in got.items()} == {0: 525000, 1: 525000, 2: 680000, 3: 300000}


def test_names(spark):
    docs = [line("Tractor Model : Mahindra 575 DI"), line("Tractor Model : Premium Edition"), [*line("SHREE GANESH MOTORCO", 40), *line("body text", 1500)], [*line("x", 10), *line("M/s Patel Motors Pvt Ltd", 1900)]]
    got = {(r.doc_id, r.field): r.value for r in text_fields.text_fields(page(spark, *docs), ["Mahindra"]).collect()}
    assert "575" in got[0, "model_name"] and got[1, "model_name"] is None
    assert got[2, "dealer_name"] == "MOTORCO SHREE GANESH" and got[3, "dealer_name"] == "Patel Motors Pvt"
    assert len(got) == 8


def test_normalisation(spark):
    dealers = spark.createDataFrame([(0, "MADHU PAVAN AUTOMOBILES", ["MADHU AUTO"])], "seq long, canonical string, aliases array<string>")
    fields = spark.createDataFrame([(0, "MADHU PAWAN AUTOMOBILES", 0.7), (1, "ENTIRELY OTHER", 0.7), (2, None, 0.0)], "doc_id long, value string, confidence double")
    got = {r.doc_id: r for r in normalize.match_dealers(fields, dealers).collect()}
    assert got[0].norm_value == "MADHU PAVAN AUTOMOBILES" and got[0].norm_confidence == pytest.approx(0.8) and got[0].match_score >= 90
    assert got[1].norm_confidence == pytest.approx(0.35) and got[1].notes == ["dealer_weak_match"] and got[2].norm_value is None
    assert [r.notes for r in normalize.match_dealers(fields, dealers.limit(0)).orderBy("doc_id").collect()] == [["no_dealer_master_loaded"], ["no_dealer_master_loaded"], []]
    assets = spark.createDataFrame([(0, "Mahindra 575 DI")], "seq long, full_name string")
    models = spark.createDataFrame([(0, "  MAHINDRA  575-DI  ", 0.7), (1, "Unknown Brand X100", 0.7)], "doc_id long, value string, confidence double")
    got = normalize.match_models(models, assets).orderBy("doc_id").collect()
    assert got[0].norm_value == "Mahindra 575 DI" and got[1].norm_confidence == pytest.approx(0.49) and got[1].notes == ["model_no_exact_match"]
    r = spark.sql("select 50L hp, 100000L cost, 0.95D c").select(normalize.cross_field(normalize.gate_horse_power(F.col("hp"), F.col("c")), normalize.gate_asset_cost(F.col("cost"), F.col("c"))).alias("x")).first().x
    assert r.confidence == pytest.approx(0.76) and r.notes == ["hp_cost_inconsistent"]


def test_confidence(spark):
    rows = spark.createDataFrame([(0, "dealer_name", 0.5), (0, "asset_cost", 0.9), (0, "stamp", 0.0), (1, "stamp", 0.0), (1, "model_name", None)], "doc_id long, field string, confidence double")
    got = {r.doc_id: (round(r.confidence, 6), r.needs_review) for r in normalize.document_confidence(rows).collect()}
    assert got == {0: (0.7, False), 1: (0.0, True)}
    assert {r.field for r in normalize.below_threshold(rows).collect()} == {"dealer_name", "stamp"}


def test_second_tier_is_grounded(spark):
    first = spark.createDataFrame([(0, "dealer_name", None, 0.0, "none", "XYZ Limited quote"), (1, "dealer_name", None, 0.0, "none", "no such name"), (2, "dealer_name", "Sure", 0.9, "tier1", "XYZ Limited")], "doc_id long, field string, value string, confidence double, source string, text string")
    second = spark.createDataFrame([(k, "dealer_name", "XYZ Limited") for k in range(3)], "doc_id long, field string, value2 string")
    got = {r.doc_id: (r.value, r.confidence) for r in normalize.merge_second_tier(first, second, normalize.grounded(F.col("value2"), F.col("text"))).collect()}
    assert got == {0: ("XYZ Limited", 0.7), 1: (None, 0.0), 2: ("Sure", 0.9)}


def test_match_rules(spark):
    rows = spark.createDataFrame([("Nimar Motors", "M/s. Nimar Motors"), ("A & B Tractors", "A and B Tractors"), (None, None), ("x", None), ("Wholly Other", "Nimar Motors")], "p string, g string")
    assert [r.x for r in rows.select(evaluate.match_dealer(F.col("p"), F.col("g")).alias("x")).collect()] == [True, True, True, False, False]
    rows = spark.createDataFrame([("mahindra 575", "Mahindra 575 DI"), ("Swaraj 744", "Mahindra 575 DI"), ("DI Mahindra", "Mahindra DI"), (None, "M")], "p string, g string")
    assert [r.x for r in rows.select(evaluate.match_model(F.col("p"), F.col("g")).alias("x")).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(100, 104), (100, 120), (None, None), (0, 0), (1, None)], "p int, g int")
    assert [r.x for r in rows.select(evaluate.match_numeric(F.col("p"), F.col("g")).alias("x")).collect()] == [True, False, True, True, False]


def test_latency(spark):
    values = [float(v) for v in range(1, 101)]
    r = evaluate.latency(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (r.n, r.p50, r.p95, r.max) == (100, 50.5, 96.0, 100.0)
    for some in ([3.5], [2.0, 2.0, 2.0], [-4.0, 1e9, 7.0, 7.5, 7.25, 1e9]):
        r = evaluate.latency(spark.createDataFrame([(v,) for v in [*some, None]], "v double"), "v").first()
        assert (r.n, r.p50, r.p95, r.max) == (len(some), statistics.median(some), sorted(some)[min(int(0.95 * len(some)), len(some) - 1)], max(some))
    assert evaluate.latency(spark.createDataFrame([], "v double"), "v").first().n == 0


def test_masters(spark):
    names = spark.createDataFrame([("MADHU PAVAN AUTOMOBILES", k) for k in range(3)] + [("MADHU PAWAN AUTOMOBILES", 3), ("SINGLE SHOP", 4), ("abc", 5)], "name string, seq long")
    (r,) = masters.star_clusters(masters.candidate_counts(names)).collect()
    assert (r.canonical, r.aliases, r.frequency) == ("MADHU PAVAN AUTOMOBILES", ["MADHU PAWAN AUTOMOBILES"], 4)
    rows = lambda n: spark.createDataFrame([("M", "575", n, 0)], "brand string, model string, full_name string, seq long")
    assert masters.union_assets(rows("Mahindra 575"), rows("MAHINDRA 575 ")).collect()[0].full_name == "Mahindra 575"


def test_clusters_compare_all_names(spark):
    """Held against the greedy loop over all names: claims across first letters, word orders and subsets."""
    names = ["BADHU PAWAN AUTOMOBILES", "PAWAN MADHU AUTOMOBILES", "MADHU PAWAN AUTOMOBILES", "SHREE GANESH", "SHREE GANESH TRACTORS", "TRACTORS", "ZUNIL SHOP", "SUNIL SHOP", "ALONE HERE"]
    rng = random.Random(4)
    for _ in range(60):
        w = [rng.choice(["RAJ", "OM", "PATEL", "KISAN", "BHARAT", "NEW"]) + rng.choice(["", "A", "I"]) for _ in range(rng.randint(1, 3))]
        names.append(" ".join([*w, rng.choice(["MOTORS", "TRACTORS", "AGRO"])]))
    seen = [*dict.fromkeys(names)]
    taken, want = set(), []
    for k, seed in enumerate(seen):
        if seed in taken:
            continue
        near = sorted((x for x in enumerate(seen) if similarity.token_set(seed, x[1]) >= 85), key=lambda x: (-similarity.token_set(seed, x[1]), x[0]))[:5]
        mine = [seed, *(x for _, x in near if x != seed and x not in taken)]
        taken.update(mine)
        if sum(names.count(x) for x in mine) >= 2:
            lead = max(mine, key=lambda x: (names.count(x), len(x)))
            want.append((lead, sorted(x for x in mine if x != lead), sum(names.count(x) for x in mine)))
    counts = masters.candidate_counts(spark.createDataFrame([(x, k) for k, x in enumerate(names)], "name string, seq long"))
    assert len(want) > 10 and any("BADHU PAWAN AUTOMOBILES" in (c, *a) and len(a) == 2 for c, a, _ in want)
    for size in (1000, 16):
        assert sorted((r.canonical, r.aliases, r.frequency) for r in masters.star_clusters(counts, size).collect()) == sorted(want)
    assert masters.star_clusters(counts.limit(0)).count() == 0


def test_similar_pairs_loses_none(spark):
    """Against all pairs of 2,000 names: spelling slips, other word orders, subsets, frequent words, repeated words, spaces."""
    rng = random.Random(11)
    syllables = ["MA", "DHU", "SHRI", "GA", "NESH", "PA", "TEL", "KI", "SAN", "RA", "JA", "OM", "É", "द"]
    stock = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(150)] + ["MOTORS", "TRACTORS", "AGRO", "AND", "CO"]
    names = {"MOTORS", "A", "  ", "MOTORS MOTORS", " SHRI\tMOTORS  "}
    while len(names) < 2000:
        words = [rng.choice(stock[:150]) for _ in range(rng.randint(1, 3))] + rng.choices(stock[150:], k=rng.randint(0, 2))
        rng.shuffle(words)
        text = list(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(["", "X", " ", "A"])
        names.add("".join(text))
    names = sorted(names)
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if similarity.token_set(names[i], names[j]) >= 85}
    table = spark.createDataFrame(list(enumerate(names)), "place long, name string")
    got = masters.similar_pairs(table, 300).collect()
    assert len(want) > 500 and {(r.a, r.b) for r in got} == want | {(j, i) for i, j in want} and len(got) == 2 * len(want)
    assert all(r.score == similarity.token_set(names[r.a], names[r.b]) for r in got)
    assert masters.similar_pairs(table.limit(0)).count() == 0


def test_detections(spark):
    rows = spark.createDataFrame([(0, 0, "signature", 0, 0, 10, 10, 0.6), (0, 1, "signature", 5, 5, 20, 20, 0.95), (0, 2, "stamp", 6, 6, 20, 20, 0.3), (0, 3, "stamp", 400, 400, 420, 420, 0.1)], "doc_id long, seq long, cls string, x1 int, y1 int, x2 int, y2 int, conf double")
    assert {(r.cls, r.seq) for r in detections.best_per_class(detections.confident(rows)).collect()} == {("signature", 1), ("stamp", 2)}
    left = detections.without_overlap(rows.where("cls = 'signature'"), rows.where("cls = 'stamp'"))
    assert [r.seq for r in left.collect()] == [0]
    parsed = detections.parse_yolo(spark.createDataFrame([("0 0.5 0.5 0.1 0.1",), ("2 0.5 0.5 0.1 0.1",), ("0 1.5 0.5 0.1 0.1",), ("0 1",), ("",)], "line string"))
    assert [r.issues for r in parsed.collect()] == [[], ["class"], ["range"], ["malformed"], ["malformed"]]
    lines = [r.line for r in detections.yolo_lines(rows, 100, 100).orderBy("seq").collect()]
    assert lines[0] == "0 0.050000 0.050000 0.100000 0.100000" and len(lines) == 4


def test_ordered_suppression_equals_the_fold(spark):
    rng = random.Random(6)
    boxes, seq = [], 0
    for doc in range(4):
        for _ in range(90):
            x, y, w, h = rng.randint(-30, 60), rng.randint(0, 40), rng.choice([0, 1, 2, 9, 10, 11, 40]), rng.choice([1, 7, 8, 9])
            boxes.append((doc, seq := seq + 1, x, y, x + w, y + h, 0.5, rng.random() < 0.8))
    boxes += [(9, k, 2 * k, 0, 2 * k + 20, 10, 0.5, True) for k in range(60)] + [(9, 100 + k, 0, 0, 20, 10, 0.5, True) for k in range(50)]  # a chain, and copies
    rng.shuffle(boxes)

    def overlap(a, b):
        shared = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return shared / max(1, sum(max(0, c[4] - c[2]) * max(0, c[5] - c[3]) for c in (a, b)) - shared)

    held = []
    for b in sorted(boxes):
        if not any(k[0] == b[0] and overlap(k, b) > 0.7 for k in held):
            held.append(b)
    table = spark.createDataFrame(boxes, "doc_id long, seq long, x1 int, y1 int, x2 int, y2 int, conf double, fine boolean").repartition(5)
    for rounds in (0, 1, 3, 50):
        got = detections.keep_first(table, valid=F.col("fine"), rounds=rounds)
        assert sorted((r.doc_id, r.seq) for r in got.collect()) == sorted(b[:2] for b in held if b[7]), rounds
    assert len(held) < 400 and detections.keep_first(table.limit(0)).count() == 0


def test_tolerant_reads_list_the_broken_files(spark, tmp_path):
    from docketry.sources import files

    folder = tmp_path / "t"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).selectExpr("cast(id as string) id", "repeat(cast(id as string), 500) as body").coalesce(1).write.mode("append").parquet(str(folder))
    parts = sorted(folder.glob("part-*.parquet"))
    (folder / "junk.parquet").write_bytes(b"not a table")
    body = bytearray(parts[0].read_bytes())
    body[8:200] = b"\xff" * 192  # the footer stays whole, the pages do not
    parts[0].write_bytes(bytes(body))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    rows, bad = files.readable(spark, str(folder), "id string, body string")
    assert rows.count() == 20 and rows.where("length(body) < 500").count() == 0
    found = {r.path.rsplit("/", 1)[-1]: r.error for r in bad.collect()}
    assert set(found) == {"junk.parquet", parts[0].name} and all(found.values())
    assert files.table_or_empty(spark, str(folder), "id string").count() in (20, 30)  # only what is asked for must be whole
    assert files.readable(spark, str(tmp_path / "none"), "id string")[1].count() == 0


def test_store(spark):
    rows = [("a", "f1.pdf", "D", "M", "completed", 95, "2.0s", "2024-01-02T00:00:00", 1), ("b", "f2.pdf", "E", "N", "processing", 0, None, "2024-01-03T00:00:00", 2)]
    s = spark.createDataFrame(rows, "id string, fileName string, dealerName string, modelName string, status string, confidence int, processingTime string, uploadedAt string, seq long")
    k = store.kpis(s).first()
    assert (k.total, k.completed, k.completion_pct, k.avg_confidence, k.avg_seconds) == (2, 1, 50.0, 95.0, 2.0)
    assert store.kpis(s.limit(0)).first().avg_confidence == 0
    assert {r.bucket: r.n for r in store.confidence_buckets(s).collect()} == {"90+": 1, "80-89": 0, "70-79": 0, "<70": 0}
    assert [r.n for r in store.daily_volume(s, F.lit("2024-01-03").cast("date")).orderBy("day").collect()] == [0, 0, 0, 0, 0, 1, 1]
    assert [r.id for r in store.newest_first(s).collect()] == ["b", "a"] and [r.id for r in store.search(s, "F1").collect()] == ["a"]
    changed = store.patch(s, spark.createDataFrame([("b", "failed")], "id string, status string"))
    assert {r.id: r.status for r in changed.collect()} == {"a": "completed", "b": "failed"}
    assert {r.id for r in store.merge_in_flight(s.where("id = 'a'"), s).collect()} == {"a", "b"}


def test_samples(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 90, "big").otherwise("small"))
    got = sampling.stratified(df, "g", [F.col("id")], 10).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"big": 9, "small": 1}
    parts = sampling.split(df, [F.col("id") * 7 % 101, F.col("id")], {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 70, "val": 15, "test": 15}
    assert sampling.uniform(df, "id", 5).collect() == sampling.uniform(df, "id", 5).collect()


def test_ranks_within_groups_of_any_size(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 40}" if i % 2 else None, i * 37 % 101) for i in range(900)]
    table = spark.createDataFrame(rows, "id long, g string, k int").repartition(7)
    got = {r.id: r._rank for r in sampling.ranked(table, [F.col("k"), F.col("id")], F.col("g")).collect()}
    for g in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    whole = sorted((r[2], r[0]) for r in rows)
    assert [r.id for r in sampling.ranked(table, [F.col("k"), F.col("id")]).orderBy("_rank").collect()] == [i for _, i in whole]
    assert sampling.stratified(table, "g", [F.col("id")], 90).where("g is null").count() == round(90 * sum(r[1] is None for r in rows) / 900)
    assert sampling.ranked(table.limit(0), [F.col("k")]).count() == 0 and sampling.stratified(table.limit(0), "g", [F.col("id")], 9).count() == 0


def test_record_faults(spark):
    from docketry.operators import validate

    good = assemble.failed(spark.createDataFrame([("a", "x")], "doc_id string, error string")).select(F.to_json(F.struct("doc_id", "fields", "confidence"), {"ignoreNullFields": "false"}).alias("value"))
    assert [r.faults for r in validate.faults(good).collect()] == [[]]
    odd = spark.createDataFrame([(None,), ("",), ("[1]",), ('{"fields":{}}',), ('{"fields":3}',)], "value string")
    got = [r.faults for r in validate.faults(odd).collect()]
    assert got[0] == got[1] == got[2] == ["unreadable"] and len(got[3]) == 6 and all(f.startswith("missing:") for f in got[3])


def test_results_and_sources(spark, tmp_path):
    from docketry.sources import adapters, files, sinks

    bad = assemble.failed(spark.createDataFrame([("d.txt", "unsupported_format: .txt")], "doc_id string, error string"))
    flat = assemble.legacy_json(bad).first().json
    assert json.loads(flat)["error"].startswith("unsupported_format") and json.loads(flat)["confidence"] == 0
    sinks.json_lines(bad, str(tmp_path / "out"))
    entries = spark.createDataFrame([("B", ["z", "a"], 2), ("A", [], 1)], "canonical string, aliases array<string>, frequency int")
    sinks.dealer_master(entries, str(tmp_path / "m1"))
    sinks.dealer_master(entries.orderBy("canonical"), str(tmp_path / "m2"))
    one, two = ("".join(p.read_text() for p in (tmp_path / m).glob("part-*")) for m in ("m1", "m2"))
    assert one == two and [e["canonical"] for e in json.loads(one)["entries"]] == ["A", "B"]
    assert [r.canonical for r in files.dealer_master(spark, str(tmp_path / "m1")).orderBy("seq").collect()] == ["A", "B"]
    assert files.dealer_master(spark, str(tmp_path / "missing.json")).count() == 0
    docs = spark.createDataFrame([(1, "Grand Total 525000"), (2, None)], "doc_id long, text string")
    tokens = adapters.apply_model(docs, adapters.text_recogniser, "doc_id", "tok_idx int, text string, x1 int, y1 int, x2 int, y2 int, conf double")
    assert tokens.where("error is not null").select("doc_id").collect()[0].doc_id == 2
    assert best(numeric_fields.asset_cost_candidates(tokens.where("error is null")))[1].value == 525000


def test_folder_to_lines(spark, tmp_path):
    from docketry.plans.batch import folder_to_lines

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_text("SHREE GANESH MOTORCO\nTractor Model : Mahindra 575 DI\nHorse Power : 50 HP\nGrand Total : 525000")
    (folder / "b.PNG").write_bytes(b"\xff\xfe broken")
    (folder / "c.txt").write_text("Grand Total 525000")
    (folder / "d.jpg").write_text(" ")
    dealers = spark.createDataFrame([(0, "SHREE GANESH MOTORCO", [])], "seq long, canonical string, aliases array<string>")
    assets = spark.createDataFrame([(0, "Mahindra", "575 DI", "Mahindra 575 DI")], "seq long, brand string, model string, full_name string")
    sign = lambda: lambda record: [{"seq": 0, "cls": "stamp", "x1": 1, "y1": 1, "x2": 9, "y2": 9, "conf": 0.9}] if record["doc_id"] == "a.pdf" else []
    ask = lambda missing: missing.where("doc_id = 'a.pdf'").selectExpr("doc_id", "named_struct('dealer_name', '\"ZYZ MOTORS\"', 'model_name', cast(null as string), 'horse_power', '\"52\"', 'asset_cost', '99') as answer")
    got = {r.doc_id: r for r in folder_to_lines(spark, str(folder), str(tmp_path / "out"), dealers, assets, detector=sign, second_tier=ask).collect()}
    assert set(got) == {"a.pdf", "b.PNG", "c.txt", "d.jpg"}
    a = got["a.pdf"].fields
    assert (a.model_name.value, a.horse_power.value, a.asset_cost.value, a.stamp.bbox, a.signature.present) == ("Mahindra 575 DI", 50, 525000, [1, 1, 9, 9], False)
    assert got["a.pdf"].error is None and got["a.pdf"].confidence > 0.5 and got["a.pdf"].processing_time_sec >= 0
    assert got["b.PNG"].error.startswith("corrupt_input") and got["c.txt"].error.startswith("unsupported_format") and got["d.jpg"].error is None and got["d.jpg"].confidence == 0
    flat = folder_to_lines(spark, str(folder), str(tmp_path / "flat"), dealers, assets, flat=True).collect()
    assert [r.doc_id for r in flat] == ["a.pdf", "b.PNG", "c.txt", "d.jpg"] and flat[0].horse_power == 50


def test_models_read_each_file_once(spark, tmp_path):
    from docketry.plans.batch import TOKEN, run_folder
    from docketry.sources import adapters, files
    from docketry.sources.cache import StageCache, mining_documents

    folder, log, seen = tmp_path / "in", tmp_path / "calls", tmp_path / "boxes"
    for p in (folder, log, seen):
        p.mkdir()
    texts = {"a.pdf": "Horse Power : 50 HP\nGrand Total : 525000", "b.png": "Grand Total : 300000", "e.jpg": " "}
    for name, text in texts.items():
        (folder / name).write_text(text)
    (folder / "bad.png").write_bytes(b"\xff\xfe")

    def counted(model, where):
        def load():
            read = model()

            def run(record):
                (where / f"{record['doc_id']}-{uuid.uuid4().hex}").touch()
                return read(record)

            return run

        return load

    calls = lambda where: collections.Counter(p.name.rsplit("-", 1)[0] for p in where.iterdir())
    dealers = spark.createDataFrame([], "seq long, canonical string, aliases array<string>")
    assets = spark.createDataFrame([], "seq long, brand string, model string, full_name string")
    cache = StageCache(spark, str(tmp_path / "cache"))
    asked = []
    second = lambda missing: asked.append(missing) or missing.selectExpr("doc_id", "named_struct('dealer_name', cast(null as string), 'model_name', cast(null as string), 'horse_power', '45', 'asset_cost', cast(null as string)) as answer")
    models = dict(recogniser=counted(adapters.page_reader, log), detector=counted(lambda: lambda r: [], seen), second_tier=second)
    first = run_folder(spark, str(folder), dealers, assets, cache=cache, **models).orderBy("doc_id").collect()
    assert calls(log) == calls(seen) == dict.fromkeys(["a.pdf", "b.png", "bad.png", "e.jpg"], 1) and len(asked) == 1
    assert [(r.doc_id, r.fields.horse_power.value, r.fields.asset_cost.value) for r in first[:2]] == [("a.pdf", 50, 525000), ("b.png", 45, 300000)]
    again = run_folder(spark, str(folder), dealers, assets, cache=StageCache(spark, str(tmp_path / "cache")), **models).orderBy("doc_id").collect()
    # what was read is not read again; faults and empty pages are, by the recogniser alone
    assert again[:2] == first[:2] and calls(log) == {"a.pdf": 1, "b.png": 1, "bad.png": 2, "e.jpg": 2} and set(calls(seen).values()) == {1}
    (folder / "b.png").write_text("Grand Total : 310000")
    changed = run_folder(spark, str(folder), dealers, assets, cache=cache, **models).orderBy("doc_id").collect()
    assert changed[1].fields.asset_cost.value == 310000 and calls(log)["b.png"] == 2 and calls(log)["a.pdf"] == 1
    # appends at the same time both stay, and one entry counts
    docs = files.all_files(spark, str(folder)).selectExpr("name as doc_id", "hash", "content").where("doc_id = 'a.pdf'")
    made = adapters.items_of(docs, adapters.page_reader, ["doc_id", "hash"], TOKEN)
    before = cache.entries("ocr", TOKEN).count()
    cache.append("ocr", made)
    cache.append("ocr", made.withColumn("doc_id", F.lit("z.pdf")))
    assert cache.entries("ocr", TOKEN).count() == before + 1
    cache.compact("ocr", TOKEN)
    assert len(cache._live("ocr")) == 1 and cache.entries("ocr", TOKEN).count() == before + 1
    # data without its record, and a record that cannot be read, do not count
    made.withColumn("doc_id", F.lit("half")).write.parquet(f"{cache.folder}/ocr/half")
    (tmp_path / "cache" / "ocr" / "_commits" / "torn.json").write_text("{")
    assert cache.entries("ocr", TOKEN).where("doc_id = 'half'").count() == 0
    (folder / "b.png").write_text("one two")
    mined = lambda **k: sorted((r.filename, len(r.tokens)) for r in mining_documents(cache, files.all_files(spark, str(folder)), counted(adapters.page_reader, log), TOKEN, **k).collect())
    n = sum(calls(log).values())
    assert mined(limit=1) == [("b.png", 2)] and mined(limit=1) == [("b.png", 2)] and sum(calls(log).values()) == n + 1
    assert mined(use_cache=False) == [("b.png", 2)] and sum(calls(log).values()) == n + 3


def test_second_tier_of_all_fields(spark):
    from docketry.plans.pipeline import missing_fields, tier_one, with_second_tier

    fields = tier_one(page(spark, line("XYZ Limited page"), line("Grand Total : 525000"), [("HP", 60, 100, 0.2), ("50", 170, 100, 0.2)]), ["Mahindra"])
    assert {r.doc_id: len(r.fields) for r in missing_fields(fields).collect()} == {0: 4, 1: 3, 2: 4}
    answers = [(0, '"XYZ Limited"', '"Invented 99"', '"45 HP"', "525000.9"), (1, None, '""', "12", "600000"), (2, '"PQR"', None, "true", '"5,25,000"')]
    table = spark.createDataFrame(answers, "doc_id long, dealer_name string, model_name string, horse_power string, asset_cost string").selectExpr("doc_id", "struct(dealer_name, model_name, horse_power, asset_cost) as answer")
    got = {r.doc_id: r for r in with_second_tier(fields, table).collect()}
    value = lambda d: [(got[d][f].value, got[d][f].source) for f in ("dealer_name", "model_name", "horse_power", "asset_cost")]
    assert value(0) == [("XYZ Limited", "tier2"), (None, "none"), (45, "tier2"), (525000, "tier2")]
    assert value(1) == [(None, "none"), (None, "none"), (None, "none"), (525000, "tier1")]
    assert value(2) == [(None, "none"), (None, "none"), (50, "tier1"), (525000, "tier2")] and got[0].dealer_name.confidence == 0.7


def test_evaluation_of_six_fields(spark):
    labels = spark.createDataFrame([("a", "Nimar Motors", "Mahindra 575 DI", 50, 525000, True, False), ("b", "Other", "M 1", 40, 1, True, True), ("c", "X", "Y", 1, 1, False, False), (None, "X", "Y", 1, 1, False, False)], "doc_id string, dealer_name string, model_name string, horse_power int, asset_cost long, signature_present boolean, stamp_present boolean")
    results = spark.createDataFrame([("a", "M/s Nimar Motors", "mahindra 575", 51, 525000, True, False, None, 2.0), ("b", None, "M 1", None, 1, False, True, None, 4.0)], "doc_id string, dealer_name string, model_name string, horse_power int, asset_cost long, signature_present boolean, stamp_present boolean, error string, processing_time_sec double")
    scored = evaluate.score_documents(labels, results)
    assert {r.doc_id: r.error for r in scored.collect()} == {"a": None, "b": None, "c": "missing"}
    r = evaluate.report(scored).first()
    assert (r.docs_total, r.docs_correct, r.errors, r.dealer_name_correct, r.model_name_correct, r.stamp_correct, r.signature_fn, r.stamp_tp, r.seconds_max) == (3, 1, 1, 1, 2, 2, 1, 1, 4.0)
    assert {x.field: x.shown for x in evaluate.report_summary(evaluate.report(scored)).collect()}["model_name"] == "2/3"


def test_readers_and_writers(spark, tmp_path):
    from docketry.sources import files, sinks

    folder = tmp_path / "docs"
    folder.mkdir()
    for name in ("b.pdf", "a.JPEG", "x.doc"):
        (folder / name).write_bytes(name.encode())
    assert [r.name for r in files.document_files(spark, str(folder)).collect()] == ["a.JPEG", "b.pdf"]
    paths = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.txt",)], "path string")
    assert {r.path: r.error for r in files.checked(paths, paths.where("path = 'a.pdf'")).collect()} == {"a.pdf": None, "b.pdf": "corrupt_input", "c.txt": "unsupported_format"}
    assets = spark.createDataFrame([("B", "2", "B 2"), ("A", "9", "A 9")], "brand string, model string, full_name string")
    sinks.asset_master(assets, str(tmp_path / "asset_master.json"))
    sinks.dealer_master(spark.createDataFrame([("D", ["d"], 1)], "canonical string, aliases array<string>, frequency int"), str(tmp_path / "dealer_master.json"))
    dealers, back = files.masters(spark, str(tmp_path))
    assert [r.full_name for r in back.orderBy("seq").collect()] == ["A 9", "B 2"] and dealers.first().aliases == ["d"]
    (tmp_path / "labels.json").write_text(json.dumps({"documents": [{"doc_id": f"d{k}", "fields": {"horse_power": k}} for k in range(3)]}))
    assert [(r.doc_id, r.horse_power) for r in files.labels(spark, str(tmp_path / "labels.json"), 2).collect()] == [("d0", 0), ("d1", 1)]
    (tmp_path / "cache.json").write_text(json.dumps({"docs": [{"filename": f"f{k}", "tokens": [{"text": "t", "bbox": [0, 0, 1, 1], "confidence": 0.5, "script": "en"}], "page_height": 9} for k in range(3)]}))
    assert [r.filename for r in files.mining_cache(spark, str(tmp_path / "cache.json"), 2).collect()] == ["f0", "f1"] and files.mining_cache(spark, str(tmp_path / "no.json")).count() == 0
    lines = spark.createDataFrame([("i1", "0 0.5 0.5 0.1 0.1"), ("i1", "bad"), ("i2", "1 0.5 0.5 0.2 0.2")], "image string, line string")
    sinks.yolo_files(lines, str(tmp_path / "yolo"))
    assert spark.read.text(str(tmp_path / "yolo")).count() == 3
    boxes = detections.pixels(detections.parse_yolo(lines), 100, 200).collect()
    assert {tuple(r.box) for r in boxes} == {(45, 90, 55, 110), (40, 80, 60, 120)}
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "i9.txt").write_text("0 1 2 3 4\n\n1 1 1 1 1\n")
    assert {(r.image, r.line) for r in files.yolo_files(spark, str(tmp_path / "txt")).collect()} == {("i9", "0 1 2 3 4"), ("i9", "1 1 1 1 1")}
    rows = spark.createDataFrame([("a", "ab12", ["t"]), ("b", "cd34", [])], "doc_id string, hash string, tokens array<string>")
    sinks.cache_append(rows, str(tmp_path / "cache"))
    cache = files.table_or_empty(spark, str(tmp_path / "cache"), "doc_id string, hash string, tokens array<string>")
    assert {r.doc_id for r in files.cache_misses(rows, cache).collect()} == {"b"} and files.cache_misses(rows, cache, None).count() == 0
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"no parquet at all")
    assert files.table_or_empty(spark, str(broken), "id string").count() == 0 and files.table_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0
    sinks.pseudo_labels(spark.createDataFrame([("a", 0.87654)], "doc_id string, hp_conf double"), str(tmp_path / "pseudo"))
    assert spark.read.json(str(tmp_path / "pseudo")).first().hp_conf == 0.877
    sinks.json_per_document(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int"), str(tmp_path / "each"))
    assert (tmp_path / "each" / "doc_id=a").is_dir()
    assert detections.detector_settings("confidence_thresholds:\n  signature: 0.20  # low\n  stamp: 0.25\nnms_iou: 0.5\n") == {"signature": 0.2, "stamp": 0.25, "nms_iou": 0.5}
    assert detections.detector_settings(None) == {"signature": 0.35, "stamp": 0.4, "nms_iou": 0.45}


def test_brands_are_literals(spark):
    tokens = page(spark, [*line("M(&M 575"), *line("Mahindra 575 DI", 400)])
    assert {r.brand for r in masters.harvest_assets(tokens, ["M(&M", "Mahindra"]).collect()} <= {"M(&M", "Mahindra"}
    assert text_fields.text_fields(tokens, ["M(&M", "Mahindra"]).where("field = 'model_name'").first().value == "M(&M 575"


def test_store_removal(spark):
    s = spark.createDataFrame([("a",), ("b",)], "id string")
    left, there = store.remove(s, "a")
    assert there and [r.id for r in left.collect()] == ["b"] and not store.remove(s, "z")[1]


def test_streams(spark, tmp_path):
    from docketry.streaming.documents import daily_volume, run_extraction, token_stream

    tokens = page(spark, line("Grand Total 525000"), line("50 HP"))
    tokens.write.parquet(str(tmp_path / "in"))
    run_extraction(token_stream(spark, str(tmp_path / "in"), tokens.schema.simpleString()[7:-1].replace(":", " ")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_id: (r.horse_power and r.horse_power.value, r.asset_cost and r.asset_cost.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (None, 525000), 1: (50, None)}
    spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'view' event_type union all select timestamp'2024-01-05 10:00:00', 'view'").write.parquet(str(tmp_path / "ev"))
    q = daily_volume(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("volume").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("volume").count() == 1


def test_entry_points_without_the_optional_part(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *a, **b):
        if name.startswith("docketry.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *a, **b)

    monkeypatch.setattr(builtins, "__import__", without)
    for k in [k for k in sys.modules if k in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, k)
    entry = importlib.import_module("__spark_entry__")
    assert "flagship_hp_accuracy" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
