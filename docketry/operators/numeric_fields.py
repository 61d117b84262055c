"""Horse power and asset cost: candidates around anchors, scored, best first.

Candidates are (value, score, seq, evidence); ``seq`` is the order of generation and breaks ties. One pass over the tokens
of a document serves both fields: only tokens that can tell are looked at beyond their shingles, only those that hold a
likely number enter an anchor's frame, and each of them that a hit reaches is a row, since generators are compiled where
functions on arrays are not. For a document's best such a place has one candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.geometry import distance, same_row, same_row_or_after
from docketry.operators.anchors import away, reading, signed, with_all_hits, with_shingles, with_signs, with_top_hit

CANDIDATE = "array<struct<value: bigint, score: double, seq: bigint, evidence: array<int>>>"
RANKED = "struct<score: double, before: bigint, value: bigint, evidence: array<int>>"
FIELDS = ("horse_power", "asset_cost")
BACK, AHEAD = 3, 6  # the widest frame of the fields
ANY_DIGIT = "[0-9०-९૦-૯]"  # of text.NATIVE_DIGITS, too
LONG = r"[0-9](?:[0-9]{4}|[.,\s][0-9])"  # what a text holds if any amount in it is sane or has the shape of rupees


def _candidate(value: Column, score: Column, seq: Column, evidence: Column) -> Column:
    return F.struct(value.cast("bigint").alias("value"), score.alias("score"), seq.cast("bigint").alias("seq"), evidence.alias("evidence"))


def _telling(tokens: DataFrame, fields: tuple[str, ...], found: Callable[..., DataFrame]) -> DataFrame:
    """The tokens that can have candidates of ``fields`` or be in one, and the first of each document, which stands for it:
    with the hits of each field that ``found`` adds, what numbers each reads as, and in ``near-3`` to ``near6`` the tokens
    with numbers around it.

    A place in a frame is a place among these tokens, so a token in reach is in the frame, and one out of reach may be, too.
    """
    whole = reading().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = {"before": F.lag("tok_idx").over(reading())} | {f"may_{f}": signed(f) for f in fields} | ({"height": F.max("y2").over(whole)} if FIELDS[1] in fields else {})
    seen = with_shingles(with_signs(tokens.withColumn("digits", F.coalesce(F.col("text").rlike(ANY_DIGIT if FIELDS[0] in fields else LONG), F.lit(False))), *fields), **more)
    kept = F.col("before").isNull() | F.col("digits")
    for f in fields:
        kept = kept | F.col(f"may_{f}")
    rows = found(seen.where(kept), *fields)
    parts, filled = [*TOKEN], F.lit(False)
    if FIELDS[0] in fields:
        rows = rows.withColumn("raw", F.when(F.col("digits"), T.first_number(F.col("text"))))
        fixed = F.when(F.col(f"{FIELDS[0]}_hits").isNotNull(), T.first_number(T.digit_repair_loose(F.col("text"))))
        rows = rows.withColumns({"number": F.when(F.col("digits"), F.coalesce("raw", T.first_number(T.digit_repair(F.col("text"))))), "fixed": fixed})
        parts, filled = [*parts, "number"], filled | (T.sanity(F.col("number"), *T.HP_RANGE) > 0)
    if FIELDS[1] in fields:
        amounts = F.transform(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]{4,}"), F.lit(0)), _grouped)
        sane = F.filter(F.transform("amounts", lambda v, k: F.struct(T.sanity(v, *T.COST_RANGE).alias("sane"), (-k).alias("k"), v.alias("value"))), lambda a: a["sane"] > 0)
        rows = rows.withColumn("amounts", F.when(F.col("text").rlike(LONG) if FIELDS[0] in fields else F.col("digits"), amounts)).withColumn("_sane", F.when(F.size("amounts") > 0, sane))
        rows = rows.withColumn("first", F.get("_sane", F.lit(0))).withColumn("likely", F.array_max("_sane")).drop("_sane")
        parts, filled = [*parts, "amounts", "first", "likely"], filled | F.col("first").isNotNull()
    reach = range(-BACK if FIELDS[0] in fields else -1, (AHEAD if FIELDS[1] in fields else BACK) + 1)
    rows = rows.withColumn("near0", F.when(filled, F.struct(*parts)))
    return rows.withColumns({f"near{k}": away(F.col("near0"), k) for k in reach if k})


def _grouped(text: Column) -> Column:
    """A number of plain digits and commas."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


TOKEN = ("tok_idx", "x1", "y1", "x2", "y2", "conf")


def _me() -> Column:
    return F.struct(*TOKEN)


def _inside() -> Column:
    """The horse power in a token itself, as read or repaired."""
    return F.coalesce(*(F.when(F.col(v).between(*T.HP_RANGE), F.col(v)) for v in ("raw", "fixed")))


def _horse_power_inside(h: Column) -> Column:
    """The candidate in the token of hit ``h`` itself, its number in ``inside``."""
    score = h["precision"] * F.col("conf") * F.when(F.col("raw") == F.col("inside"), 1.0).otherwise(0.85)
    return F.when(F.col("inside").isNotNull(), _candidate(F.col("inside"), score, h["seq"] * 10_000, F.array("tok_idx")))


def _horse_power_beside(h: Column, t: Column) -> Column:
    """The candidate of hit ``h`` in another token up to three away on its row."""
    offset, sane = t["tok_idx"] - F.col("tok_idx"), T.sanity(t["number"], *T.HP_RANGE)
    score = h["precision"] * F.least(F.col("conf"), t["conf"]) * T.proximity(distance(_me(), t)) * sane * 0.9
    ok = t["number"].isNotNull() & (offset != 0) & offset.between(-BACK, BACK) & same_row(_me(), t) & (sane > 0)
    return F.when(ok, _candidate(t["number"], score, h["seq"] * 10_000 + F.when(offset < 0, offset + 4).otherwise(offset + 3), F.array(F.col("tok_idx"), t["tok_idx"])))


def _cost_reached(t: Column) -> Column:
    """Whether a token's amounts are taken: from the token before to six behind, on its row or below."""
    offset = t["tok_idx"] - F.col("tok_idx")
    return offset.between(-1, AHEAD) & ((offset == 0) | same_row_or_after(_me(), t))


def _asset_cost(h: Column, t: Column, value: Column, k: Column) -> Column:
    """The candidate of hit ``h`` that is amount ``k`` of token ``t``."""
    offset, sane = t["tok_idx"] - F.col("tok_idx"), T.sanity(value, *T.COST_RANGE)
    px = F.when(offset == 0, F.lit(0.0)).otherwise(distance(_me(), t))
    score = h["precision"] * F.least(F.col("conf"), t["conf"]) * T.proximity(px) * sane
    return _candidate(value, score, h["seq"] * 10_000 + (offset + 1) * 100 + k, F.when(offset == 0, F.array("tok_idx")).otherwise(F.array(F.col("tok_idx"), t["tok_idx"])))


def _shaped(pattern: str, weight: float, kind: int) -> Column:
    """Candidates of a token's own numbers of a shape, without any anchor."""
    lo, hi = T.COST_RANGE

    def one(text: Column, k: Column) -> Column:
        value = T.to_int(text) if kind == 2 else _grouped(text)
        ok = value.between(lo, hi)
        if kind == 3:
            ok = ok & ~text.rlike("^[789][0-9]{6}$")
        return F.when(ok, _candidate(value, F.lit(weight) * F.col("conf"), F.col("tok_idx") * 1000 + kind * 100 + k, F.array("tok_idx")))

    return F.array_compact(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), one)).cast(CANDIDATE)


def _unanchored(tokens: DataFrame, hit: Column) -> DataFrame:
    """``formatted`` and ``plain`` candidates of tokens in the lower 70 per cent of their page, but for those with a ``hit`` that
    have an amount themselves: their document has an anchored one."""
    low = (F.col("y1") >= F.col("height") * 0.30) & ~(hit & F.col("first").isNotNull())
    none = F.array().cast(CANDIDATE)
    formatted = F.concat(_shaped(r"[0-9]{1,3}(?:,[0-9]{2,3})+", 0.55, 1), _shaped(r"[0-9]{1,3}(?:[.,\s][0-9]{2,3}){2,}", 0.50, 2))
    return tokens.withColumns({
        "formatted": F.when(low & F.col("text").rlike(r"[0-9][.,\s][0-9]"), formatted).otherwise(none),
        "plain": F.when(low & F.col("text").rlike("[0-9]{6}"), _shaped(r"\b[0-9]{6,7}\b", 0.40, 3)).otherwise(none),
    })


def horse_power_candidates(tokens: DataFrame) -> DataFrame:
    """A row for each candidate. The outer generator keeps the optimizer from evaluating the patterns once more in a filter."""
    rows = _telling(tokens, FIELDS[:1], with_all_hits).withColumn("h", F.explode_outer("horse_power_hits")).where("h is not null")
    near = F.array(F.lit(None), *(F.col(f"near{k}") for k in range(-BACK, BACK + 1) if k))  # the first stands for the token itself
    rows = rows.select("doc_id", *TOKEN, "raw", "fixed", "h", F.posexplode(near).alias("at", "t")).where("at = 0 or t is not null").withColumn("inside", _inside())
    made = F.when(F.col("at") == 0, _horse_power_inside(F.col("h"))).otherwise(_horse_power_beside(F.col("h"), F.col("t")))
    return rows.select("doc_id", F.inline_outer(F.array(made))).where("seq is not null")


def asset_cost_candidates(tokens: DataFrame) -> DataFrame:
    """Anchored candidates; where a document has none, rupee-shaped numbers in its lower 70 per cent."""
    page = Window.partitionBy("doc_id")
    hit = F.size("asset_cost_hits") > 0
    made = _unanchored(_telling(tokens, FIELDS[1:], with_all_hits), F.coalesce(hit, F.lit(False)))
    places = [F.col(f"near{k}") for k in range(-1, AHEAD + 1)]
    made = made.withColumn("anchored", F.when(hit, F.coalesce(*(F.when(t["first"].isNotNull() & _cost_reached(t), True) for t in places))))
    # of plain numbers the lowest on the page counts, the first of equals
    lowest = F.max(F.when(F.size("plain") > 0, F.struct("y1", -F.col("tok_idx")))).over(page) == F.struct("y1", -F.col("tok_idx"))
    some = lambda c: F.coalesce(F.max(c).over(page), F.lit(False))
    kind = F.when(some(F.col("anchored")), F.when(F.col("anchored"), 1)).when(some(F.size("formatted") > 0), F.when(F.size("formatted") > 0, 2)).when(lowest, 3)
    rows = made.withColumn("kind", kind).where("kind is not null").withColumn("h", F.explode_outer(F.when(F.col("kind") == 1, F.col("asset_cost_hits"))))  # outer, as above
    # anchored: a row for each hit, token in reach and amount; else the token alone
    rows = rows.select("doc_id", *TOKEN, "kind", "h", "formatted", "plain", F.explode_outer(F.when(F.col("kind") == 1, F.array(*places))).alias("t"))
    rows = rows.where((F.col("kind") > 1) | F.col("t.first").isNotNull() & _cost_reached(F.col("t")))
    rows = rows.select("doc_id", *TOKEN, "kind", "h", "formatted", "plain", "t", F.posexplode_outer("t.amounts").alias("k", "v"))
    made = F.when(T.sanity(F.col("v"), *T.COST_RANGE) > 0, _asset_cost(F.col("h"), F.col("t"), F.col("v"), F.col("k")))
    chosen = F.when(F.col("kind") == 1, F.array(made).cast(CANDIDATE)).when(F.col("kind") == 2, F.col("formatted")).otherwise(F.slice("plain", 1, 1))
    return rows.select("doc_id", F.inline_outer(chosen)).where("seq is not null")


def _rank(c: Column) -> Column:
    """A candidate in an order that a maximum keeps."""
    return F.when(c.isNotNull(), F.struct(c["score"].alias("score"), (-c["seq"]).alias("before"), c["value"].alias("value"), c["evidence"].alias("evidence")))


def _ranked(candidates: Column) -> Column:
    """The best of an array of candidates."""
    return F.array_max(F.transform(candidates, _rank)).cast(RANKED)


def best_fields(tokens: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id and for each of ``fields`` a struct (value, confidence, source, evidence), of all documents, in one pass.

    A row for each token that a hit reaches, of which the best counts: of the hits of one token the most trusted, and of the
    amounts of another token the most likely, or the first where confidence makes them equal. Generators are outer, as a
    filter would evaluate their arrays once more.
    """
    made, t, own = _telling(tokens, fields, with_top_hit), F.col("t"), F.col("at") == 0
    hit, keep, wanted = F.coalesce(*(F.col(f"{f}_hits.anchor") for f in fields)).isNotNull(), [f"{f}_hits" for f in fields], F.col("before").isNull()
    if FIELDS[0] in fields:
        keep = [*keep, "raw", "fixed"]
    if FIELDS[1] in fields:
        # a generator or a filter with a function on arrays is not compiled, so these stay outside
        lone = {"formatted": F.when(F.size("formatted") > 0, _ranked(F.col("formatted"))), "plain": F.when(F.size("plain") > 0, _ranked(F.slice("plain", 1, 1)))}
        made = _unanchored(made, F.col("asset_cost_hits").isNotNull()).withColumns(lone)
        keep, wanted = [*keep, *lone], wanted | F.col("formatted").isNotNull() | F.col("plain").isNotNull()
    place = lambda k: F.struct(F.lit(k).alias("at"), F.col(f"near{k}").alias("t"))
    places = F.when(hit, F.array(*(place(k) for k in range(-BACK, AHEAD + 1) if f"near{k}" in made.columns))).otherwise(F.array(place(0)))
    rows, kept, tops = made.select("doc_id", *TOKEN, "before", *keep, F.inline_outer(places)).where("at = 0 or t is not null"), own & wanted, {}
    if FIELDS[0] in fields:
        h = F.col("horse_power_hits")
        rows = rows.withColumn("inside", _inside()).withColumn("hp", F.explode_outer(F.array(F.when(h.isNotNull(), F.when(own, _horse_power_inside(h)).otherwise(_horse_power_beside(h, t))))))
        kept, tops["horse_power"] = kept | F.col("hp").isNotNull(), F.max(_rank(F.col("hp")))
    if FIELDS[1] in fields:
        h, a = F.col("asset_cost_hits"), F.col("a")
        rows = rows.withColumn("a", F.when(F.least(F.col("conf"), t["conf"]) > 0, t["likely"]).otherwise(t["first"]))
        rows = rows.withColumn("cost", F.explode_outer(F.array(F.when(h.isNotNull() & a.isNotNull() & _cost_reached(t), _asset_cost(h, t, a["value"], -a["k"])))))
        plain = F.max(F.when(own & F.col("plain").isNotNull(), F.struct("y1", -F.col("tok_idx"), F.col("plain").alias("top"))))
        kept, tops["asset_cost"] = kept | F.col("cost").isNotNull(), F.coalesce(F.max(_rank(F.col("cost"))), F.max("formatted"), plain["top"])
    found = rows.where(kept).groupBy("doc_id").agg(*(top.alias(name) for name, top in tops.items()))
    return found.select("doc_id", *(_field(F.col(f)).alias(f) for f in FIELDS if f in fields))


def _field(top: Column) -> Column:
    return F.struct(
        top["value"].alias("value"),
        F.coalesce(T.unit(top["score"]), F.lit(0.0)).alias("confidence"),
        F.when(top.isNull(), "none").otherwise("tier1").alias("source"),
        F.coalesce(top["evidence"], F.array().cast("array<int>")).alias("evidence"),
    )


def best(candidates: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, value, confidence, source and evidence of the best candidate; documents of ``docs`` without one get a null."""
    top = candidates.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("seq")).alias("before"), "value", "evidence")).cast(RANKED).alias("top"))
    rows = docs.select("doc_id").join(top, "doc_id", "left") if docs is not None else top
    return rows.select("doc_id", F.inline(F.array(_field(F.col("top")))))
