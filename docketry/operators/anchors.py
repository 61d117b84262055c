"""Anchored regex hits over one-, two- and three-token shingles.

A shingle's hit belongs to its last token, so each token looks back at its own row's two predecessors: one
window pass over tokens partitioned by document gives shingles, hits and any context frames together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docketry.functions.geometry import same_row

# Anchor patterns and how far each is trusted, in the order in which they are tried
ANCHORS: dict[str, tuple[tuple[str, float], ...]] = {
    "horse_power": (
        (r"\bH\.?P\.?\b", 0.95), (r"(?<=[0-9])\s*H\.?P\.?\b", 0.95), (r"\bhp\b", 0.92), (r"(?<=[0-9])\s*hp\b", 0.92), (r"HP\b", 0.85),
        (r"horse\s*power", 0.95), ("एचपी", 0.92), ("बल", 0.85), ("બળ", 0.85),
    ),
    "asset_cost": (
        (r"grand\s*total", 0.97), (r"net\s*amount", 0.95), (r"net\s*total", 0.94), (r"total\s*cost", 0.94), (r"total\s*amount", 0.92), (r"\btotal\b", 0.78),
        ("रकम", 0.85), ("कुल", 0.85), ("કુલ", 0.85), ("₹", 0.70), (r"\bRs\.?\b", 0.70), (r"\bINR\b", 0.78),
    ),
    "dealer_name": ((r"authorized\s+dealer", 0.95), (r"authorised\s+dealer", 0.95), (r"\bdealer\s*[:\-]", 0.85), (r"\bM/s\.?\b", 0.90), ("मेसर्स", 0.85)),
    "model_name": ((r"tractor\s*model", 0.95), (r"\bmodel\s*[:\-]", 0.92), (r"\bmodel\s+name\b", 0.94), (r"asset\s*model", 0.92)),
}

# What a text in lower case holds if any of a field's anchors matches, within one token of it
NEEDLES = {"horse_power": ("hp", "h.p", "horse", "एचपी", "बल", "બળ"), "asset_cost": ("total", "amount", "रकम", "कुल", "કુલ", "₹"), "dealer_name": ("dealer", "m/s", "मेसर्स"), "model_name": ("model",)}
# What it may hold instead, as a word of its own; as parts of words these are common
WORDS = {"asset_cost": ("rs", "inr")}
# What a match of any of a field's anchors can begin with
BEGINS = {"horse_power": "hएबબ", "asset_cost": "gntriरकક₹", "dealer_name": "admम", "model_name": "tma"}

TOKEN = ("tok_idx", "text", "x1", "y1", "x2", "y2", "conf")


def reading() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("tok_idx")


def reading_order(boxes: DataFrame) -> DataFrame:
    """``tok_idx`` from boxes: rows of 20 px top to bottom, then left to right, then ``seq``."""
    order = Window.partitionBy("doc_id").orderBy(F.floor(F.col("y1") / 20), "x1", "seq")
    return boxes.withColumn("tok_idx", F.row_number().over(order) - 1)


def away(token: Column, k: int) -> Column:
    """``token`` of the row ``k`` places on, or back if negative."""
    return F.lead(token, k).over(reading()) if k > 0 else F.lag(token, -k).over(reading()) if k < 0 else token


def beside(token: Column, first: int, last: int) -> Column:
    """Array of ``token`` of the rows from ``first`` to ``last`` places away, in order, nulls left out. Each place is a look at
    one row, where a moving frame would be gathered anew for every row."""
    return F.array_compact(F.array(*(away(token, k) for k in range(first, last + 1))))


def with_ahead(tokens: DataFrame, most: int) -> DataFrame:
    """The tokens of ``begins`` with ``ahead``, ``me`` of the up to ``most`` tokens behind each, and the first of each document,
    which stands for it. Only tokens that one looks ahead to are looked at, and only those that look carry an array."""
    near = {"_near": F.max("begins").over(reading().rowsBetween(-most, 0)), "_first": F.lag("tok_idx").over(reading()).isNull()}
    framed = tokens.withColumns(near).where("_near or _first").withColumns({f"_a{k}": away(F.col("me"), k) for k in range(1, most + 1)})
    made = framed.where("begins or _first").withColumn("ahead", F.array_compact(F.array(*(F.col(f"_a{k}") for k in range(1, most + 1)))))
    return made.drop("_near", "_first", *(f"_a{k}" for k in range(1, most + 1)))


def with_signs(tokens: DataFrame, *fields: str) -> DataFrame:
    """Adds ``sign_`` and the name of each field: whether the token holds a part without which no anchor of the field matches."""
    low = tokens.withColumn("_low", F.lower("text"))
    some = lambda parts: F.greatest(*(F.contains("_low", F.lit(n)) for n in parts)) if len(parts) > 1 else F.contains("_low", F.lit(parts[0]))

    def holds(f: str) -> Column:
        words = WORDS.get(f)
        return some(NEEDLES[f]) | some(words) & F.col("text").rlike(rf"(?i)\b(?:{'|'.join(words)})\b") if words else some(NEEDLES[f])

    return low.withColumns({f"sign_{f}": F.coalesce(holds(f), F.lit(False)) for f in fields}).drop("_low")


def signed(field: str) -> Column:
    """Whether the token or one of the two before it has the field's sign: only such a token can have hits."""
    sign = F.col(f"sign_{field}")
    return sign | F.lag(sign, 1, False).over(reading()) | F.lag(sign, 2, False).over(reading())


def with_shingles(tokens: DataFrame, **more: Column) -> DataFrame:
    """Adds ``me`` (the token), ``two`` and ``three`` (joined texts that end here, null across rows), and ``more`` columns of the
    same pass."""
    before = lambda k: F.lag(F.struct("text", "y1", "y2"), k).over(reading())
    seen = tokens.withColumns({"_p1": before(1), "_p2": before(2), **more}).withColumn("me", F.struct(*TOKEN))
    two = F.when(same_row(F.col("_p1"), F.col("me")), F.concat_ws(" ", "_p1.text", "text"))
    three = F.when(same_row(F.col("_p2"), F.col("_p1")) & same_row(F.col("_p2"), F.col("me")), F.concat_ws(" ", "_p2.text", "_p1.text", "text"))
    return seen.withColumn("two", two).withColumn("three", three).drop("_p1", "_p2")


HIT = "struct<anchor: int, precision: double, seq: bigint>"


def _hit(k: Column, precision: Column, first: Column) -> Column:
    return F.struct(k.alias("anchor"), precision.alias("precision"), (first + k).cast("long").alias("seq"))


def _first() -> Column:
    """What the order of discovery of a token's hits begins with."""
    tok = F.col("tok_idx")
    return F.when(F.col("three").isNotNull(), (tok - 2) * 1000 + 300).when(F.col("two").isNotNull(), (tok - 1) * 1000 + 200).otherwise(tok * 1000 + 100)


def _longest() -> Column:
    return F.coalesce("three", "two", "text")


def hits(field: str) -> Column:
    """Array of (anchor, precision, seq) that hit a token of ``with_shingles``; ``seq`` is the order of discovery.

    A text that an anchor matches is matched within any longer shingle that ends alike, so the longest shingle tells alone,
    and one pattern of all anchors on it tells most tokens apart.
    """
    found = F.array_compact(F.array(*(F.when(_longest().rlike(f"(?i){p}"), _hit(F.lit(k), F.lit(w), _first())) for k, (p, w) in enumerate(ANCHORS[field]))))
    return F.when(has_hits(field), found).otherwise(F.array().cast(f"array<{HIT}>"))


def with_all_hits(shingles: DataFrame, *fields: str) -> DataFrame:
    """Adds ``hits`` of each field where ``may_`` and its name, as its name and ``_hits``. The patterns give a bit each in
    compiled code, which a function on arrays would keep them out of."""

    def bits(field: str) -> Column:
        found = (F.when(F.col("_longest").rlike(f"(?i){p}"), 1 << k).otherwise(0) for k, (p, _) in enumerate(ANCHORS[field]))
        return F.when(F.col(f"may_{field}"), F.when(has_hits(field), sum(found, F.lit(0))).otherwise(0))

    def told(field: str) -> Column:
        every = F.array(*(F.struct(F.lit(1 << k).alias("bit"), F.lit(k).alias("k"), F.lit(w).alias("precision")) for k, (_, w) in enumerate(ANCHORS[field])))
        set_ = F.filter(every, lambda a: F.col(f"_bits_{field}").bitwiseAND(a["bit"]) != 0)
        some = F.transform(set_, lambda a: _hit(a["k"], a["precision"], F.col("_start")))
        return F.when(F.col(f"_bits_{field}") > 0, some).when(F.col(f"_bits_{field}") == 0, F.array().cast(f"array<{HIT}>"))

    rows = shingles.withColumns({"_longest": _longest(), "_start": _first()}).withColumns({f"_bits_{f}": bits(f) for f in fields})
    return rows.withColumns({f"{f}_hits": told(f) for f in fields}).drop("_longest", "_start", *(f"_bits_{f}" for f in fields))


def with_top_hit(shingles: DataFrame, *fields: str) -> DataFrame:
    """As ``with_all_hits``, but the most trusted one, the first of equals, or null: no pattern is tried after it. The patterns
    give a number only, so that a stage's code for them is short enough to be compiled."""

    def number(field: str) -> Column:
        found = F
        for k, (pattern, _) in sorted(enumerate(ANCHORS[field]), key=lambda a: -a[1][1]):
            found = found.when(F.col("_longest").rlike(f"(?i){pattern}"), k)
        return F.when(F.col(f"may_{field}") & has_hits(field), found)

    told = shingles.withColumn("_longest", _longest()).withColumns({f"_k_{f}": number(f) for f in fields})
    trust = lambda f: F.element_at(F.array(*(F.lit(w) for _, w in ANCHORS[f])), F.col(f"_k_{f}") + 1)
    made = told.withColumns({f"{f}_hits": F.when(F.col(f"_k_{f}").isNotNull(), _hit(F.col(f"_k_{f}"), trust(f), _first())) for f in fields})
    return made.drop("_longest", *(f"_k_{f}" for f in fields))


def has_hits(*fields: str) -> Column:
    """Whether any anchor of ``fields`` hits the token. A match that begins with white space is one without it, too: only what
    the fields' matches can begin with is looked at."""
    every = "|".join(f"(?:{p})" for f in fields for p, _ in ANCHORS[f])
    return _longest().rlike(f"(?i)(?=[{''.join(BEGINS[f] for f in fields)}])(?:{every})")


def anchor_hits(tokens: DataFrame, field: str) -> DataFrame:
    """doc_id, tok_idx, anchor, precision and seq of each hit of the field's anchors."""
    return with_hits(with_shingles(tokens), field).select("doc_id", "tok_idx", "anchor", "precision", "seq")


def with_hits(shingles: DataFrame, field: str) -> DataFrame:
    """A row for each hit. The outer generator keeps the optimizer from evaluating the patterns once more in a filter."""
    return shingles.select("*", F.inline_outer(hits(field))).where("anchor is not null")
