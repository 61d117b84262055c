"""The engine's queries by name, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import geometry as G
from docketry.functions import similarity
from docketry.functions import text as T
from docketry.operators import anchors, assemble, detections, evaluate, imaging, masters, normalize, numeric_fields, pages, sampling, store, text_fields, validate
from docketry.plans import surrogates as S
from docketry.sources.images import page_images as read_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


@query
def flagship_hp_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, candidates, best, range gate, truth: the share of quotations whose horse power is right."""
    truth = S.quotes(spark, sf_dir)
    best = numeric_fields.best_fields(S.quote_tokens(spark, sf_dir, truth), ("horse_power",))
    gated = best.select("doc_id", normalize.gate_horse_power(F.col("horse_power.value"), F.col("horse_power.confidence")).alias("g"))
    joined = truth.select("doc_id", "hp").join(gated, "doc_id", "left").select("hp", F.col("g.value").alias("got"), F.coalesce("g.confidence", F.lit(0.0)).alias("c"))
    hit = evaluate.match_numeric(F.col("got"), F.col("hp"))
    return joined.agg(big(F.count("*")).alias("docs"), big(F.count("got")).alias("found"), big(F.count_if(hit)).alias("correct"), six(F.avg("c")).alias("mean_confidence"))


@query
def tokens_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = S.doc_tokens(spark, sf_dir).withColumn("seq", F.col("line") * 1_000_000 + F.col("pos"))
    ordered = anchors.reading_order(tokens)
    return ordered.groupBy("doc_id").agg(big(F.count("*")).alias("tokens"), big(F.max("tok_idx")).alias("last"), F.min_by("text", "tok_idx").alias("first_text"), F.max_by("text", "tok_idx").alias("last_text"), big(F.sum(F.col("tok_idx") * F.char_length("text"))).alias("checksum"))


@query
def script_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.doc_tokens(spark, sf_dir).groupBy(T.script(F.col("text")).alias("script")).agg(big(F.count("*")).alias("tokens"), big(F.countDistinct("doc_id")).alias("docs"))


def _anchor_query(field: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return anchors.anchor_hits(S.quote_tokens(spark, sf_dir), field).select("doc_id", big("tok_idx").alias("tok_idx"), big("anchor").alias("anchor"), "precision", "seq")

    run.__name__ = f"anchor_hits_{field}"
    query(run)


for _field in ("horse_power", "asset_cost", "dealer_name", "model_name"):
    _anchor_query(_field)


@query
def hp_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_fields.horse_power_candidates(S.quote_tokens(spark, sf_dir)).select("doc_id", "value", six("score").alias("score"), "seq")


@query
def hp_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numeric_fields.best_fields(S.quote_tokens(spark, sf_dir), ("horse_power",)).select("doc_id", "horse_power.*")
    return found.select("doc_id", "value", six("confidence").alias("confidence"), "source")


@query
def cost_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_fields.asset_cost_candidates(S.quote_tokens(spark, sf_dir)).select("doc_id", "value", six("score").alias("score"), "seq")


@query
def cost_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numeric_fields.best_fields(S.quote_tokens(spark, sf_dir), ("asset_cost",)).select("doc_id", "asset_cost.*")
    return found.where("source <> 'none'").select("doc_id", "value", six("confidence").alias("confidence"), "source")


def _text_best(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    found = text_fields.text_bests(S.quote_tokens(spark, sf_dir), ["Mahindra", "Sonalika"], fields=(field,))
    return found.select("doc_id", f"{field}.value", six(f"{field}.confidence").alias("confidence"), f"{field}.source")


@query
def dealer_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_best(spark, sf_dir, "dealer_name")


@query
def model_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_best(spark, sf_dir, "model_name")


@query
def letterhead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fields.letterhead_lines(S.quote_tokens(spark, sf_dir)).select("doc_id", big("line").alias("line"), "text", "ok")


@query
def digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = S.read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w")).where("w <> ''")
    words = every.groupBy("w").agg(F.count("*").alias("n"))  # a maximum of texts is sorted for, so each word comes once
    repaired = words.select("n", T.digit_repair(F.col("w")).alias("strict"), T.digit_repair_loose(F.col("w")).alias("loose"))
    return repaired.groupBy(F.char_length("loose").cast("bigint").alias("length")).agg(
        big(F.sum("n")).alias("words"), big(F.sum(F.when(F.col("strict") == F.col("loose"), F.col("n")).otherwise(0))).alias("same"), big(F.sum(F.char_length(F.regexp_replace("loose", "[^0-9]", "")) * F.col("n"))).alias("digits"), F.max("strict").alias("largest")
    )


@query
def int_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2), F.lit("/-"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey", T.to_int(text).alias("value"))


@query
def proximity_and_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.boxes(spark, sf_dir).select("seq", detections.box().alias("b"), F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(100).alias("x2"), F.lit(20).alias("y2")).alias("o"))
    d = G.distance(F.col("b"), F.col("o"))
    return b.select("seq", d.alias("distance"), six(T.proximity(d)).alias("proximity"), T.sanity(F.col("seq") % 250, 15, 150).alias("sanity"))


@query
def derive_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    hp = F.col("hp").cast("string")
    name = F.when(k == 0, F.concat(F.lit("YUVO 405 DI (HP-"), hp, F.lit(")"))).when(k == 1, F.concat(F.lit("Tech 405 D1 HP. "), hp, F.lit("!"))).when(k == 2, F.concat(F.lit("MF 245 DI "), hp, F.lit(" HP"))).when(k == 3, F.concat(F.lit("3805P+ "), hp, F.lit("HP"))).otherwise(F.concat(F.lit("PT-4"), hp))
    return S.quotes(spark, sf_dir).select("doc_id", big(T.hp_from_text(name)).alias("hp"))


def _numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gated horse power and cost of each quotation that has either, null without a candidate; one pass over the tokens."""
    found = numeric_fields.best_fields(S.quote_tokens(spark, sf_dir)).where("horse_power.source <> 'none' or asset_cost.source <> 'none'")
    gated = lambda f, gate: F.when(F.col(f"{f}.source") != "none", gate(F.col(f"{f}.value"), F.col(f"{f}.confidence")))
    return found.select("doc_id", gated("horse_power", normalize.gate_horse_power).alias("hp"), gated("asset_cost", normalize.gate_asset_cost).alias("cost"))


@query
def normalize_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _numeric(spark, sf_dir).withColumn("cost", normalize.cross_field(F.col("hp"), F.col("cost")))
    return checked.select("doc_id", F.col("hp.value").alias("hp"), F.col("cost.value").alias("cost"), six("cost.confidence").alias("cost_confidence"), F.concat_ws(",", "hp.notes", "cost.notes").alias("notes"))


@query
def model_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.read(spark, sf_dir, "part")
    assets = p.where("p_partkey % 3 <> 0").select(F.col("p_name").alias("full_name"), F.col("p_partkey").alias("seq"))
    fields = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("  -")))).otherwise(F.col("p_name")).alias("value"), F.lit(0.7).alias("confidence"))
    done = normalize.match_models(fields, assets)
    return done.select("p_partkey", F.col("norm_value").alias("value"), six("norm_confidence").alias("confidence"), "match_score", F.concat_ws(",", "notes").alias("notes"))


@query
def dealer_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = S.read(spark, sf_dir, "nation")
    dealers = nations.select(F.concat_ws(" ", "n_name", F.lit("AUTOMOBILES")).alias("canonical"), F.array(F.concat_ws(" ", "n_name", F.lit("TRACTORS"))).alias("aliases"), F.col("n_nationkey").alias("seq"))
    segments = S.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").join(nations, "n_nationkey")
    value = F.concat_ws(" ", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.substring("n_name", 1, 3), F.lit("X"), F.substring("n_name", 5, 30))).otherwise(F.col("n_name")), F.when(F.col("c_custkey") % 2 == 0, "TRACTORS").otherwise(F.col("c_mktsegment")))
    done = normalize.match_dealers(segments.select("c_custkey", value.alias("value"), F.lit(0.7).alias("confidence")), dealers)
    return done.select("c_custkey", "value", F.col("norm_value").alias("norm_value"), six("norm_confidence").alias("confidence"), six("match_score").alias("score"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    typo = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.substring("n_name", 1, 2), F.lit("Z"), F.substring("n_name", 4, 30))).otherwise(F.col("n_name"))
    rows = S.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").join(S.read(spark, sf_dir, "nation"), "n_nationkey")
    return rows.select(F.concat_ws(" ", typo, "c_mktsegment", F.lit("MOTORS")).alias("name"), F.col("c_custkey").alias("seq"))


@query
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masters.candidate_counts(_names(spark, sf_dir)).select("name", big("n").alias("n"), "first")


@query
def dealer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = masters.star_clusters(masters.candidate_counts(_names(spark, sf_dir)))
    return made.select("canonical", F.concat_ws("|", "aliases").alias("aliases"), big("frequency").alias("frequency"))


@query
def asset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.read(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.concat_ws(" ", "p_brand", "p_type").alias("full_name"), F.col("p_partkey").alias("seq"))
    return masters.union_assets(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1").withColumn("full_name", F.lower("full_name")))


@query
def brand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masters.brands(S.read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")))


@query
def asset_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masters.harvest_assets(S.quote_tokens(spark, sf_dir), ["Mahindra", "Sonalika"])


@query
def dealer_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masters.harvest_dealers(S.quote_tokens(spark, sf_dir))


@query
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _numeric(spark, sf_dir)
    long = both.select("doc_id", F.inline(F.array(F.struct(F.lit("horse_power").alias("field"), F.col("hp.confidence").alias("confidence")), F.struct(F.lit("asset_cost").alias("field"), F.col("cost.confidence").alias("confidence")))))
    visual = detections.best_per_class(detections.confident(S.boxes(spark, sf_dir))).where("cls in ('signature', 'stamp')").select("doc_id", F.col("cls").alias("field"), F.col("conf").alias("confidence"))
    seen = visual.join(both.select("doc_id"), "doc_id", "left_semi")
    return normalize.document_confidence(long.unionByName(seen)).select("doc_id", six("confidence").alias("confidence"), "needs_review")


@query
def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.best_per_class(S.boxes(spark, sf_dir)).select("doc_id", "cls", *(big(c).alias(c) for c in detections.BOX), "conf", "seq")


@query
def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.confident(S.boxes(spark, sf_dir)).groupBy("cls").agg(big(F.count("*")).alias("n"), F.min("conf").alias("least"), F.max("conf").alias("most"))


@query
def detection_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.top_per_class(S.boxes(spark, sf_dir), {"stamp": 2, "signature": 1}).select("doc_id", "cls", "seq", big("rank").alias("rank"))


@query
def iou_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.boxes(spark, sf_dir)
    return detections.without_overlap(b.where("cls = 'signature'"), b.where("cls = 'stamp'")).select("doc_id", "seq")


@query
def iou_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.keep_first(S.boxes(spark, sf_dir)).select("doc_id", "seq")


@query
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.annotation_summary(S.boxes(spark, sf_dir)).select(*(big(c).alias(c) for c in ("with_sig", "with_stamp", "both", "neither")))


@query
def page_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scored(S.doc_pages(spark, sf_dir)).select("page_id", six("relevance_score").alias("relevance_score"))


@query
def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sampled(S.doc_pages(spark, sf_dir)).select("doc", "page_id", big("page_index").alias("page_index"))


@query
def best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.best(pages.scored(pages.sampled(S.doc_pages(spark, sf_dir)))).select("doc", big("page_index").alias("page_index"), six("relevance_score").alias("relevance_score"))


@query
def legacy_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _numeric(spark, sf_dir)
    seen = detections.best_per_class(detections.confident(S.boxes(spark, sf_dir))).groupBy("doc_id").agg(*(F.max(F.when(F.col("cls") == c, F.struct("conf", F.array(*detections.BOX).alias("b")))).alias(c) for c in detections.CLASSES))
    none = F.lit(None).cast("string")
    rows = both.join(seen, "doc_id", "left").select(
        "doc_id", none.alias("dealer_name"), F.lit(0.0).alias("dealer_conf"), none.alias("model_name"), F.lit(0.0).alias("model_conf"), F.col("hp.value").alias("horse_power"), F.col("hp.confidence").alias("hp_conf"),
        F.col("cost.value").alias("asset_cost"), F.col("cost.confidence").alias("cost_conf"), *(F.col(f"{c}.b").alias(f"{c}_box") for c in detections.CLASSES), *(F.col(f"{c}.conf").alias(f"{c}_conf") for c in detections.CLASSES),
        F.lit(0.5).alias("confidence"), F.lit(1.25).alias("processing_time_sec"), F.lit(0.0).alias("cost_estimate_usd"),
    )
    flat = assemble.legacy(assemble.nested(rows))
    return flat.select("doc_id", big("horse_power").alias("horse_power"), "asset_cost", "signature_present", F.concat_ws(",", "signature_bbox").alias("signature_bbox"), "stamp_present", F.concat_ws(",", "stamp_bbox").alias("stamp_bbox"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = S.quotes(spark, sf_dir).select("doc_id", F.col("hp").alias("hp_true"), F.col("cost").alias("cost_true"))
    rows = truth.join(_numeric(spark, sf_dir), "doc_id", "left")
    return rows.select("doc_id", evaluate.match_numeric(F.col("hp.value"), F.col("hp_true")).alias("horse_power"), evaluate.match_numeric(F.col("cost.value"), F.col("cost_true")).alias("asset_cost"))


@query
def eval_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_accuracy(_scored(spark, sf_dir), ["horse_power", "asset_cost"]).select("field", big("correct").alias("correct"), big("total").alias("total"), six("accuracy").alias("accuracy"))


@query
def eval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hit_histogram(_scored(spark, sf_dir), ["horse_power", "asset_cost"]).select(big("hits").alias("hits"), big("docs").alias("docs"))


@query
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "labels").join(S.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return evaluate.confusion(rows, F.lower("text").rlike("idiot|moron|stupid|clown"), F.col("toxic") == 1).select(*(big(c).alias(c) for c in ("tp", "fp", "tn", "fn")))


@query
def eval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(S.read(spark, sf_dir, "events"), "value").select(big("n").alias("n"), six("p50").alias("p50"), six("p95").alias("p95"), six("max").alias("max"))


@query
def eval_model_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.quotes(spark, sf_dir)
    truth = F.concat(F.lit("Mahindra "), F.col("model"), F.lit(" DI"))
    k = F.col("doc_id") % 4
    got = F.when(k == 0, F.upper(truth)).when(k == 1, F.concat(F.lit("mahindra "), F.col("model") + 1)).when(k == 2, F.concat(F.col("model"), F.lit("-DI, MAHINDRA tractor")))
    return q.select("doc_id", evaluate.match_model_plain(got, truth).alias("hit"))


@query
def below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _numeric(spark, sf_dir)
    long = both.select("doc_id", F.inline(F.array(F.struct(F.lit("horse_power").alias("field"), F.col("hp.confidence").alias("confidence")), F.struct(F.lit("asset_cost").alias("field"), F.col("cost.confidence").alias("confidence")))))
    return normalize.below_threshold(long).groupBy("field").agg(big(F.count("*")).alias("n"), six(F.max("confidence")).alias("most"))


@query
def tier2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub of a language model answers for weak costs; its value counts only where the page has it."""
    tokens = S.quote_tokens(spark, sf_dir)
    best = numeric_fields.best(numeric_fields.asset_cost_candidates(tokens))
    text = tokens.groupBy("doc_id").agg(T.text_of(F.collect_list(F.struct("tok_idx", "text"))).alias("text"))
    first = best.join(text, "doc_id").select("doc_id", F.lit("asset_cost").alias("field"), F.col("value").cast("string").alias("value"), "confidence", "source", "text")
    stub = S.quotes(spark, sf_dir).select("doc_id", F.lit("asset_cost").alias("field"), F.when(F.col("doc_id") % 3 == 0, F.lit("999")).otherwise(F.col("cost").cast("string")).alias("value2"))
    done = normalize.merge_second_tier(first, stub, normalize.in_text(F.col("value2"), F.col("text")))
    return done.select("doc_id", "value", six("confidence").alias("confidence"), "source")


@query
def json_blob_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Answer: "), F.col("props"), F.when(F.col("event_id") % 10 == 0, "} trailing").otherwise(" ok"))
    blob = T.json_blob(raw)
    return S.read(spark, sf_dir, "events").select("event_id", F.get_json_object(blob, "$.k").try_cast("bigint").alias("k"), blob.isNotNull().alias("parsed"))


@query
def inr_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None)).otherwise(F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 7) * (F.col("o_orderkey") % 5))).cast("bigint")
    return S.read(spark, sf_dir, "orders").select("o_orderkey", T.inr(amount).alias("shown"), T.size_kb(F.col("o_orderkey")).alias("size"))


@query
def dash_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = store.kpis(S.store(spark, sf_dir))
    return k.select(big("total").alias("total"), big("completed").alias("completed"), *(six(c).alias(c) for c in ("completion_pct", "avg_confidence", "avg_seconds")))


@query
def dash_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.daily_volume(S.store(spark, sf_dir), F.lit("2024-02-02").cast("date")).select("day", big("n").alias("n"))


@query
def dash_confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.confidence_buckets(S.store(spark, sf_dir)).select("bucket", big("n").alias("n"))


@query
def dash_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 > 0, F.col("lang")).alias("lang"))
    return store.languages(docs).select("lang", big("n").alias("n"))


@query
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.queue_counts(S.store(spark, sf_dir)).select("status", big("n").alias("n"))


@query
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(S.store(spark, sf_dir), "DEALER 7", "completed").select("id")


@query
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.store(spark, sf_dir)
    again = s.where("seq % 3 = 0").withColumn("status", F.lit("completed")).withColumn("seq", F.col("seq") + 10_000_000)
    return store.upsert(s, again).groupBy("status").agg(big(F.count("*")).alias("n"), big(F.max("seq")).alias("last"))


@query
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.store(spark, sf_dir)
    return store.delete(s, s.where("status = 'failed'").select("id")).groupBy("status").agg(big(F.count("*")).alias("n"))


@query
def store_merge_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.store(spark, sf_dir)
    return store.merge_in_flight(s.where("seq % 2 = 0"), s.where("seq % 3 = 0")).groupBy("status").agg(big(F.count("*")).alias("n"))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.stratified(docs, "source", [F.col("doc_id") * 7919 % 10007, F.col("doc_id")], 60).select("doc_id", "source")


@query
def split_70_15_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select("doc_id")
    return sampling.split(docs, [F.col("doc_id") * 7919 % 10007, F.col("doc_id")], {"train": 0.7, "val": 0.15, "test": 0.15}).select("doc_id", "part")


@query
def labels_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.missing(S.read(spark, sf_dir, "documents"), S.read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query
def yolo_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.yolo_lines(S.boxes(spark, sf_dir), 600, 750).select("seq", "line")


@query
def yolo_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = detections.yolo_lines(S.boxes(spark, sf_dir), 512, 700)
    spoiled = lines.withColumn("line", F.when(F.col("seq") % 11 == 0, F.concat(F.lit("7"), F.substring("line", 2, 100))).when(F.col("seq") % 13 == 0, F.concat("line", F.lit(" 1"))).otherwise(F.col("line")))
    r = detections.yolo_report(detections.parse_yolo(spoiled))
    return r.select(*(big(c).alias(c) for c in r.columns))


@query
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    hi = docs.agg((F.max("n_chars") + 1).cast("double").alias("hi"))
    return docs.join(hi, F.lit(True)).groupBy(big(F.width_bucket(F.col("n_chars").cast("double"), F.lit(0.0), F.col("hi"), F.lit(20))).alias("bin")).agg(big(F.count("*")).alias("docs"), six(F.percentile("n_chars", 0.5)).alias("median"))


@query
def filename_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    stem = F.when(e % 4 == 0, F.concat(F.lit("Android_"), e)).when(e % 4 == 1, F.concat(F.lit("others-"), e)).when(e % 4 == 2, (e + 1_000_000_000).cast("string")).otherwise(F.concat(F.lit("scan "), e))
    return S.read(spark, sf_dir, "events").groupBy(T.filename_bucket(stem).alias("bucket")).agg(big(F.count("*")).alias("n"))


@query
def brand_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(big(F.countDistinct("l_orderkey")).alias("docs"))


@query
def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _numeric(spark, sf_dir)
    sure = (F.col("hp.confidence") >= 0.85) & (F.col("cost.confidence") >= 0.85)
    return both.agg(big(F.count("*")).alias("docs"), big(F.count_if(sure)).alias("sure"), six(F.avg(F.coalesce(sure, F.lit(False)).cast("int"))).alias("share"))


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("hash"))
    known = docs.where("doc_id % 3 = 0").select("hash").distinct()
    return docs.join(known, "hash", "left_anti").select("doc_id", "hash")


@query
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quote_tokens(spark, sf_dir).groupBy("doc_id").agg(T.text_of(F.collect_list(F.struct("tok_idx", "text"))).alias("text"))


@query
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.quote_tokens(spark, sf_dir)
    return t.groupBy("doc_id", big(F.floor(F.col("y1") / 25)).alias("line")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("x1", "text"))), lambda x: x["text"])).alias("text"))


@query
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path from tokens and detections to flat records, against part and nation names as masters."""
    from docketry.plans.pipeline import extract

    nations = S.read(spark, sf_dir, "nation")
    dealers = nations.select(F.concat_ws(" ", "n_name", F.lit("AUTOMOBILE TRACTORS")).alias("canonical"), F.array().cast("array<string>").alias("aliases"), F.col("n_nationkey").alias("seq"))
    sizes = S.read(spark, sf_dir, "part").select((F.col("p_size") + 500).alias("m")).distinct().where("m % 2 = 0")
    assets = sizes.select(F.lit("Mahindra").alias("brand"), F.concat_ws(" ", "m", F.lit("DI")).alias("model"), F.concat_ws(" ", F.lit("Mahindra"), "m", F.lit("DI")).alias("full_name"), F.col("m").alias("seq"))
    flat = assemble.legacy(extract(S.quote_tokens(spark, sf_dir), S.boxes(spark, sf_dir), dealers, assets))
    return flat.select("doc_id", "dealer_name", "model_name", big("horse_power").alias("horse_power"), "asset_cost", "signature_present", "stamp_present", six("confidence").alias("confidence"))


@query
def coerce_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 6
    literal = F.when(k == 0, "true").when(k == 1, e.cast("string")).when(k == 2, F.concat(e, F.lit(".75"))).when(k == 3, F.concat(F.lit('"Rs. '), e, F.lit(',000"'))).when(k == 4, "null").otherwise(F.concat(F.lit("-"), e))
    return S.read(spark, sf_dir, "events").select("event_id", T.coerce_int(literal).alias("value"))


@query
def manual_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    typed = F.when(k == 0, F.concat(F.lit("₹"), F.format_number(F.floor("o_totalprice"), 0))).when(k == 1, F.concat(F.lit("Rs. "), F.floor("o_totalprice"))).when(k == 2, F.concat(F.floor("o_totalprice"), F.lit(" only"))).otherwise(F.concat(F.lit(" "), F.floor("o_totalprice"), F.lit(" ")))
    return S.read(spark, sf_dir, "orders").select("o_orderkey", T.manual_int(typed).alias("value"))


@query
def evaluation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("M/s. "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "&Sons").otherwise(" & Co."))
    return S.read(spark, sf_dir, "customer").select("c_custkey", T.evaluation_key(name).alias("key"))


@query
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.filter(F.array(F.lit("stamp"), F.when(F.col("c_custkey") % 2 == 0, "asset_cost"), F.when(F.col("c_custkey") % 3 == 0, "dealer_name")), lambda f: f.isNotNull())
    return S.read(spark, sf_dir, "customer").select("c_custkey", T.prompt(F.col("c_name"), fields).alias("prompt"))


@query
def quad_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = e % 300 - 20.5, e * 7 % 200 - 9.5
    quad = F.array(point(x, y), point(x + e % 9, y + 1.25), point(x + e % 9 - 0.5, y + e % 5), point(x - 1.0, y + e % 5 - 0.25))
    return S.read(spark, sf_dir, "events").select("event_id", G.quad_box(quad).alias("b")).select("event_id", *(big(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query
def schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = S.boxes(spark, sf_dir).withColumn("x2", F.when(F.col("seq") % 17 == 0, F.col("x1")).otherwise(F.col("x2"))).withColumn("conf", F.when(F.col("seq") % 23 == 0, 1.5).otherwise(F.col("conf")))
    return boxes.agg(big(F.count_if(~G.well_formed(detections.box()))).alias("bad_boxes"), big(F.count_if(~F.col("conf").between(0, 1))).alias("bad_confidences"))


@query
def detections_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.by_confidence(S.boxes(spark, sf_dir)).select("doc_id", "seq", big("place").alias("place"))


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    w, h = 12 + e % 190, 10 + e * 3 % 90
    return S.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), e.alias("seq"), (e * 13 % 800).alias("x"), (e * 29 % 1100).alias("y"), w.alias("w"), h.alias("h"), (w * h * (20 + e % 70) / F.lit(100.0)).alias("area"), (2.0 * (w + h) + e % 40).alias("arc"), (e % 60 / F.lit(100.0)).alias("density"), F.lit(1000).alias("page_w"), F.lit(1400).alias("page_h"))


@query
def stamp_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detections.stamp_shapes(_outlines(spark, sf_dir))
    return detections.top_per_class(found, {"stamp": 2}).select("doc_id", "seq", *(big(c).alias(c) for c in detections.BOX), six("conf").alias("conf"))


@query
def signature_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outlines = _outlines(spark, sf_dir)
    stamps = detections.top_per_class(detections.stamp_shapes(outlines), {"stamp": 2})
    found = detections.top_per_class(detections.signature_shapes(outlines, stamps), {"signature": 1})
    return found.select("doc_id", "seq", *(big(c).alias(c) for c in detections.BOX), six("conf").alias("conf"))


@query
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.sources.files import cached

    docs = S.read(spark, sf_dir, "documents")
    cache = docs.select(F.explode(F.array(F.lit("b"), F.lit("a"))).alias("h"), "doc_id", "n_chars").select(F.concat("doc_id", F.lit("::"), "h", F.col("doc_id") % 7).alias("key"), (F.col("n_chars") + F.ascii("h")).alias("size"))
    return cached(S.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id")), cache).select("doc_id", "key", big("size").alias("size"))


@query
def detection_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.sources.files import cache_misses as lacking

    docs = S.read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("hash"))
    stored = docs.where("doc_id % 3 = 0").withColumn("tokens", F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))))
    sides = ((lacking(docs, stored), "recognition"), (lacking(docs, stored, None), "detection"))
    return sides[0][0].withColumn("side", F.lit(sides[0][1])).unionByName(sides[1][0].withColumn("side", F.lit(sides[1][1]))).select("side", "doc_id", "hash")


@query
def image_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.sources.files import image_labels

    e = F.col("event_id")
    rows = S.read(spark, sf_dir, "events")
    return image_labels(rows.select(F.concat(F.lit("/data/images/scan."), e, F.lit(".png")).alias("path")), rows.where(e % 3 == 0).select(F.concat(F.lit("labels/scan."), e, F.lit(".txt")).alias("path"))).select("path", "label_path")


@query
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masters.most_common(S.read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"))).select("name", big("n").alias("n"), big("place").alias("place"))


@query
def issue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = detections.yolo_lines(S.boxes(spark, sf_dir), 512, 700).select(F.format_string("%08d", "seq").alias("image"), F.lit(1).alias("number"), F.when(F.col("seq") % 11 == 0, F.concat(F.lit("7"), F.substring("line", 2, 100))).otherwise(F.col("line")).alias("line"))
    return detections.issue_head(detections.parse_yolo(lines)).select(big("place").alias("place"), "image", "issue")


@query
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(S.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 40, order=F.col("doc_id") * 7919 % 10007)


@query
def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest_first(store.public(S.store(spark, sf_dir).withColumn("_file", F.lit("x")))).limit(50).select("id", "uploadedAt", "seq")


@query
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, none = F.col("seq"), F.lit(None).cast("string")
    rows = S.boxes(spark, sf_dir).select(
        e.cast("string").alias("doc_id"), F.when(e % 3 > 0, F.concat(F.lit("Dealer "), "doc_id")).otherwise(none).alias("dealer_name"), F.lit(0.5).alias("dealer_conf"), none.alias("model_name"), F.lit(0.0).alias("model_conf"),
        F.when(e % 4 > 0, 15 + e % 100).cast("int").alias("horse_power"), F.lit(0.9).alias("hp_conf"), F.when(e % 5 > 0, e * 137).cast("bigint").alias("asset_cost"), F.lit(0.9).alias("cost_conf"),
        F.when(F.col("cls") == "signature", F.array(*detections.BOX)).alias("signature_box"), F.col("conf").alias("signature_conf"), F.lit(None).cast("array<int>").alias("stamp_box"), F.lit(0.0).alias("stamp_conf"),
        F.col("conf").alias("confidence"), (e % 97 / F.lit(8.0)).alias("processing_time_sec"), F.lit(0.0).alias("cost_estimate_usd"),
    )
    named = assemble.nested(rows).withColumn("fileName", F.concat(F.lit("scan "), "doc_id", F.when(F.col("doc_id").cast("long") % 6 == 0, "").otherwise(".PDF"))).withColumns({"bytes": F.col("doc_id").cast("long") * 31, "mimeType": none, "uploadedAt": F.lit("2024-01-01T00:00:00")})
    r = store.record(named)
    return r.select("id", "fileSize", "fileType", "mimeType", big("confidence").alias("confidence"), *(F.col(f"extractedFields.{c}").alias(c) for c in ("dealerName", "modelName", "horsePower", "assetCost", "signatureDetected", "stampDetected")), F.concat_ws(",", "extractedFields.signatureBbox").alias("signatureBbox"))


@query
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a folder of image files, broken files as errors."""
    pages = read_pages(spark, S.scans(spark, sf_dir))
    return pages.select("name", "page_index", "page_count", "width", "height", big(F.length("pixels")).alias("n_bytes"), "error")


@query
def page_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the decoded samples, the threshold of dark and light, and the skew of each page."""
    return imaging.levels(read_pages(spark, S.scans(spark, sf_dir))).select("name", "page_index", "red", "green", "blue", "threshold", six("skew").alias("skew"))


@query
def page_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps by the outlines of coloured ink."""
    found = detections.top_per_class(detections.stamp_shapes(imaging.stamp_outlines(read_pages(spark, S.scans(spark, sf_dir)))), {"stamp": 2})
    return found.select("doc_id", "cls", "x1", "y1", "x2", "y2", six("conf").alias("conf"))


@query
def eval_dealer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dealer rule: equal sets of words, or a part of the name that is long enough."""
    labels, results = S.six_fields(spark, sf_dir)
    both = labels.select("doc_id", F.col("dealer_name").alias("truth")).join(results.select("doc_id", "dealer_name"), "doc_id")
    return both.select("doc_id", evaluate.match_dealer(F.col("dealer_name"), F.col("truth")).alias("hit"))


@query
def eval_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model rule with its similarity legs."""
    labels, results = S.six_fields(spark, sf_dir)
    both = labels.select("doc_id", F.col("model_name").alias("truth")).join(results.select("doc_id", "model_name"), "doc_id")
    return both.select("doc_id", evaluate.match_model(F.col("model_name"), F.col("truth")).alias("hit"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(evaluate.score_documents(*S.six_fields(spark, sf_dir)))


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six fields: the whole report, one row."""
    made = _report(spark, sf_dir)
    return made.select(*(big(c).alias(c) if kind in ("bigint", "int") else six(c).alias(c) for c, kind in made.dtypes))


@query
def eval_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_summary(_report(spark, sf_dir)).select("field", "shown", six("accuracy").alias("accuracy"))


@query
def sure_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations that are sure of all four fields, as labels."""
    from docketry.plans.pipeline import tier_one

    sure = normalize.sure_fields(tier_one(S.quote_tokens(spark, sf_dir), ["Mahindra", "Sonalika"], text=False), 0.6)
    return sure.select("doc_id", F.col("dealer_name.value").alias("dealer_name"), F.col("model_name.value").alias("model_name"), big("horse_power.value").alias("horse_power"), big("asset_cost.value").alias("asset_cost"))


@query
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines with planted faults against the schema."""
    return validate.faults(S.result_lines(spark, sf_dir)).select("doc_id", F.concat_ws(",", "faults").alias("faults"))


@query
def repeated_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stuttered(spark, sf_dir).select("p_partkey", F.array_join(similarity.without_repeated_tail(F.col("words")), " ").alias("name"))


@query
def echoed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stuttered(spark, sf_dir).select("p_partkey", F.array_join(similarity.without_echoes(F.col("words")), " ").alias("name"))


@query
def folder_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a folder of files to records: each model once a file, error codes for what cannot be read."""
    from docketry.plans.batch import run_folder

    dealers = spark.createDataFrame([], "seq long, canonical string, aliases array<string>")
    assets = spark.createDataFrame([], "seq long, brand string, model string, full_name string")
    done = run_folder(spark, S.papers(spark, sf_dir), dealers, assets)
    return done.select("doc_id", big("fields.horse_power.value").alias("horse_power"), big("fields.asset_cost.value").alias("asset_cost"), F.substring_index("error", ":", 1).alias("error"))


@query
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a folder of PDF files: its text layer and the size of the scan that fills it."""
    return read_pages(spark, S.packets(spark, sf_dir)).select("name", "page_index", "page_count", "text", "width", "height", "error")


@query
def pdf_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most relevant page of each PDF file, among those looked at, and what it says."""
    seen = pages.scored(pages.sampled(read_pages(spark, S.packets(spark, sf_dir)).withColumn("doc", F.col("name"))))
    best = pages.best(seen)
    return best.join(seen.select("doc", "page_index", "text"), ["doc", "page_index"]).select("doc", "page_index", six("relevance_score").alias("relevance_score"), "text")


@query
def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put beside those that are there; nothing is replaced."""
    every = S.store(spark, sf_dir)
    return store.insert(every.where("seq % 3 > 0"), every.where("seq % 2 = 0")).groupBy("status").agg(big(F.count("*")).alias("n"), big(F.countDistinct("id")).alias("ids"))
