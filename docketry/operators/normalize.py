"""Normalisation against master data, range gates, cross-field check, confidence and below-threshold fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.similarity import partial_reaches, token_set_ratio

THRESHOLD = 0.55
REVIEW = 0.70
COST_PER_HP = (6000, 20000)
# Weights of the fields in a document's confidence
WEIGHTS = {"dealer_name": 0.20, "model_name": 0.20, "horse_power": 0.15, "asset_cost": 0.20, "signature": 0.125, "stamp": 0.125}
SMALL_BYTES = 32 << 20  # a dimension of at most so many bytes is broadcast
BLOCK_FORMS = 512  # forms that a value is compared with in one row


def _dimension(df: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if kind.startswith(("array", "struct")) else F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes]
    size = df.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def _note(condition: Column, code: str) -> Column:
    return F.array_compact(F.array(F.when(condition, code)))


def range_gate(value: Column, confidence: Column, lo: int, hi: int, code: str) -> Column:
    """(value, confidence, notes): out of range or null becomes null at confidence 0."""
    ok = value.between(lo, hi)
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, confidence).otherwise(0.0).alias("confidence"), _note(value.isNotNull() & ~ok, code).alias("notes"))


def gate_horse_power(value: Column, confidence: Column) -> Column:
    return range_gate(value, confidence, *T.HP_RANGE, "hp_out_of_range")


def gate_asset_cost(value: Column, confidence: Column) -> Column:
    return range_gate(value, confidence, *T.COST_RANGE, "cost_out_of_range")


def cross_field(hp: Column, cost: Column) -> Column:
    """The cost field, damped and noted where cost per horse power is out of band."""
    per = cost["value"] / F.nullif(hp["value"], F.lit(0))
    odd = F.coalesce((hp["value"] > 0) & ~per.between(*COST_PER_HP), F.lit(False))
    return F.struct(
        cost["value"].alias("value"),
        F.when(odd, cost["confidence"] * 0.8).otherwise(cost["confidence"]).alias("confidence"),
        F.concat(cost["notes"], _note(odd, "hp_cost_inconsistent")).alias("notes"),
    )


def match_models(fields: DataFrame, assets: DataFrame) -> DataFrame:
    """``fields`` (value, confidence) with the first asset (by ``seq``) of the same exact-match key.

    Adds norm_value, norm_confidence, match_score and notes.
    """
    keyed = assets.select(T.match_key(F.col("full_name")).alias("key"), "full_name", "seq")
    first = _dimension(keyed.groupBy("key").agg(F.min_by("full_name", "seq").alias("master")))
    empty = assets.isEmpty()
    raw = F.btrim("value")
    joined = fields.withColumn("key", T.match_key(F.col("value"))).join(first, "key", "left")
    none = raw.isNull() | (raw == "")
    hit = F.col("master").isNotNull()
    return joined.select(
        *fields.columns,
        F.when(none, None).otherwise(F.coalesce("master", raw)).alias("norm_value"),
        F.when(none, 0.0).when(F.lit(empty), F.col("confidence")).when(hit, F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence") * 0.7).alias("norm_confidence"),
        F.when(hit & ~none, 100.0).alias("match_score"),
        F.when(none, F.array().cast("array<string>")).when(F.lit(empty), F.array(F.lit("no_asset_master_loaded"))).otherwise(_note(~hit, "model_no_exact_match")).alias("notes"),
    )


def match_dealers(fields: DataFrame, dealers: DataFrame) -> DataFrame:
    """``fields`` (value, confidence) with the dealer form of the highest token-set ratio, the first of equals.

    ``dealers``: canonical, aliases, seq. A form that several dealers share stands for the last of them.
    Distinct values are compared with blocks of forms, a row for each value and block; blocks are broadcast within
    ``SMALL_BYTES``, else values and blocks are shuffled by block.
    """
    forms = dealers.select("seq", "canonical", F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k", "form"))
    forms = forms.groupBy("form").agg(F.min(F.struct("seq", "k")).alias("rank"), F.max_by("canonical", F.struct("seq", "k")).alias("canonical"))
    known = forms.count()
    if not known:
        none = F.btrim("value").isNull() | (F.btrim("value") == "")
        notes = F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_dealer_master_loaded")))
        return fields.select(*fields.columns, F.when(~none, F.btrim("value")).alias("norm_value"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("norm_confidence"), F.lit(None).cast("double").alias("match_score"), notes.alias("notes"))
    count = -(-known // BLOCK_FORMS)
    blocks = forms.groupBy(F.pmod(F.xxhash64("form"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("form", "rank", "canonical")).alias("forms"))  # about BLOCK_FORMS a row
    values = fields.select(F.btrim("value").alias("raw")).where("raw <> ''").distinct()
    dealt = values.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    scored = F.transform("forms", lambda f: F.struct(token_set_ratio(F.col("raw"), f["form"]).alias("score"), (-f["rank"]["seq"]).alias("seq"), (-f["rank"]["k"]).alias("k"), f["canonical"].alias("canonical")))
    best = dealt.join(_dimension(blocks), "block").select("raw", F.array_max(scored).alias("best")).groupBy("raw").agg(F.max("best").alias("best"))
    score, confidence = F.col("best.score"), F.col("confidence")
    joined = fields.withColumn("raw", F.btrim("value")).join(best, "raw", "left")
    return joined.select(
        *fields.columns,
        F.when(score >= 90, F.col("best.canonical")).when(F.col("raw") != "", F.col("raw")).alias("norm_value"),
        F.when(score >= 90, F.least(F.lit(1.0), confidence + 0.10)).when(score >= 70, confidence * 0.85).when(score.isNotNull(), confidence * 0.5).otherwise(0.0).alias("norm_confidence"),
        score.alias("match_score"),
        F.concat(_note((score >= 70) & (score < 90), "dealer_partial_match"), _note(score < 70, "dealer_weak_match")).alias("notes"),
    )


def document_confidence(fields: DataFrame, weights: dict[str, float] | None = None, review: float = REVIEW) -> DataFrame:
    """doc_id, confidence and needs_review from (doc_id, field, confidence): the weighted mean over non-zero fields."""
    weights = weights or WEIGHTS
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    c = T.unit(F.coalesce("confidence", F.lit(0.0)))
    weight = F.when(c > 0, F.coalesce(F.try_element_at(table, F.col("field")), F.lit(0.0))).otherwise(0.0)
    summed = fields.groupBy("doc_id").agg(F.sum(weight * c).alias("s"), F.sum(weight).alias("w"))
    doc = F.coalesce(F.try_divide("s", "w"), F.lit(0.0))
    return summed.select("doc_id", doc.alias("confidence"), (doc < review).alias("needs_review"))


def below_threshold(fields: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return fields.where(F.col("confidence") < threshold)


SURE = 0.85


def sure_fields(fields: DataFrame, least: float = SURE, names: tuple[str, ...] = ("dealer_name", "model_name", "horse_power", "asset_cost")) -> DataFrame:
    """``fields`` (a struct with confidence for each name) of the documents that are sure of every one: labels by the rules."""
    every = F.lit(True)
    for name in names:
        every = every & (F.coalesce(F.col(f"{name}.confidence"), F.lit(0.0)) >= least)
    return fields.where(every)


def merge_second_tier(first: DataFrame, second: DataFrame, grounded: Column) -> DataFrame:
    """(doc_id, field) rows of ``first`` (value, confidence, source, text), overwritten where weak and ``second``
    (value2) has a grounded value; such fields get confidence 0.7."""
    joined = first.join(second, ["doc_id", "field"], "left")
    weak = F.col("value").isNull() | (F.col("confidence") < THRESHOLD)
    take = weak & (F.btrim(F.coalesce("value2", F.lit(""))) != "") & F.coalesce(grounded, F.lit(False))
    return joined.select("doc_id", "field", F.when(take, F.col("value2")).otherwise(F.col("value")).alias("value"), F.when(take, 0.7).otherwise(F.col("confidence")).alias("confidence"), F.when(take, "tier2").otherwise(F.col("source")).alias("source"))


def in_text(value: Column, text: Column) -> Column:
    """The verbatim part of the grounding guard: a value occurs in the text, but for case and white space."""
    return (T.plain_key(value) != "") & F.contains(T.plain_key(text), T.plain_key(value))


def grounded(value: Column, text: Column) -> Column:
    """The whole guard: verbatim, or a partial ratio of at least 85."""
    loose = F.when(in_text(value, text), None).otherwise(T.plain_key(value))  # what is there verbatim is not compared
    return in_text(value, text) | ((loose != "") & (T.plain_key(text) != "") & partial_reaches(loose, T.plain_key(text), 85))


def sanitize_second_tier(values: Column) -> Column:
    """Type and range gates on a struct of a language model's answers, each a JSON literal or null."""
    hp, cost = T.coerce_int(values["horse_power"]), T.coerce_int(values["asset_cost"])
    said = lambda k: F.btrim(F.get_json_object(F.concat(F.lit('{"v":'), values[k], F.lit("}")), "$.v"))
    text = lambda k: F.when(F.btrim(values[k]).startswith('"') & (said(k) != ""), said(k)).alias(k)
    return F.struct(text("dealer_name"), text("model_name"), F.when(hp.between(*T.HP_RANGE), hp).alias("horse_power"), F.when(cost.between(*T.COST_RANGE), cost).alias("asset_cost"))


def with_answer(field: Column, answer: Column, allowed: Column | None = None) -> Column:
    """A field struct (value, confidence, source, evidence), overwritten at confidence 0.7 if it is weak and answered."""
    take = (field["value"].isNull() | (field["confidence"] < THRESHOLD)) & answer.isNotNull()
    take = F.coalesce(take if allowed is None else take & allowed, F.lit(False))
    return F.struct(F.when(take, answer).otherwise(field["value"]).alias("value"), F.when(take, 0.7).otherwise(field["confidence"]).alias("confidence"), F.when(take, "tier2").otherwise(field["source"]).alias("source"), field["evidence"].alias("evidence"))


def derive_horse_power(rows: DataFrame) -> DataFrame:
    """hp, hp_conf filled from the model name, then from the whole text, where hp is null or below 0.3."""
    weak = lambda v, c: v.isNull() | (c < 0.3)
    from_model, from_text = T.hp_from_text(F.col("model_value")), T.hp_from_text(F.col("full_text"))
    use_model = weak(F.col("hp"), F.col("hp_conf")) & from_model.isNotNull()
    use_text = weak(F.col("hp"), F.col("hp_conf")) & from_model.isNull() & from_text.isNotNull()
    value = F.when(use_model, from_model).when(use_text, from_text).otherwise(F.col("hp"))
    confidence = F.when(use_model, F.greatest(F.lit(0.6), F.least(F.lit(0.85), F.col("model_conf")))).when(use_text, 0.55).otherwise(F.col("hp_conf"))
    return rows.withColumn("hp", value).withColumn("hp_conf", confidence)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
