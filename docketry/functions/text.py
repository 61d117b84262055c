"""String and number expressions on columns; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HP_RANGE = (15, 150)
COST_RANGE = (100_000, 5_000_000)

# Native digits that a number may be written in, and what recognition takes digits for
NATIVE_DIGITS = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯"
PLAIN_DIGITS = "01234567890123456789"
REPAIR = ("qQoOlIzZsSbBgGtT", "9900112255889977")
REPAIR_LOOSE = ("qQoOlIzZsSbBgG", "99001122558899")

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
NOT_WORD = r"[^\p{L}\p{N}_\s]"

# Keywords that make a page likely to be the wanted one, and their weights
RELEVANCE = (
    ("total", 2.0), ("grand total", 3.0), ("net amount", 2.0), ("net total", 2.0), ("invoice", 2.5), ("quotation", 3.0), ("proforma", 2.5),
    ("रू", 1.5), ("कुल", 2.0), ("रकम", 1.5), ("કુલ", 2.0), ("model", 1.5), ("tractor", 2.5), ("hp", 1.5), ("h.p", 1.5), ("बल", 1.0),
    ("एचपी", 1.5), ("બળ", 1.0), ("dealer", 1.5), ("m/s", 1.0), ("authorized dealer", 2.0), ("₹", 1.5), ("rs.", 1.5), ("rs ", 0.8), ("inr", 1.0),
)


def script(text: Column) -> Column:
    """``mixed`` if both Indic scripts occur, else ``hi``, ``gu`` or ``en``."""
    hi, gu = text.rlike("[ऀ-ॿ]"), text.rlike("[઀-૿]")
    return F.when(hi & gu, "mixed").when(hi, "hi").when(gu, "gu").otherwise("en")


def to_int(text: Column) -> Column:
    """All digits of a text as one number, null without any; a decimal point is dropped like any sign."""
    plain = F.translate(text, NATIVE_DIGITS, PLAIN_DIGITS)
    return F.regexp_replace(plain, "[^0-9]", "").try_cast("bigint")


def first_number(text: Column) -> Column:
    found = F.regexp_extract(F.translate(text, NATIVE_DIGITS, PLAIN_DIGITS), NUMBER, 0)
    return F.when(found != "", to_int(found))


def digit_repair(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.translate(text, *REPAIR)).otherwise(text)


def digit_repair_loose(text: Column) -> Column:
    return F.translate(text, *REPAIR_LOOSE)


def proximity(px: Column) -> Column:
    return F.when(px <= 80, 1.0).when(px >= 300, 0.55).otherwise(1.0 - (px - 80) / F.lit(220.0) * 0.45)


def sanity(value: Column, lo: int, hi: int) -> Column:
    return F.when(value.between(lo, hi), 1.0).when((value >= lo * 0.7) & (value <= hi * 1.3), 0.5).otherwise(0.0)


def match_key(text: Column) -> Column:
    """Exact-match key: signs to spaces, runs of spaces to one, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(text, NOT_WORD, " "), r"\s+", " ")))


def evaluation_key(text: Column) -> Column:
    return match_key(F.replace(text, F.lit("&"), F.lit(" and ")))


def unit(x: Column) -> Column:
    """Clamped to [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


# How horse power is written inside a model's name, in the order in which the forms are tried
HP_FORMS = (r"(?i)\bH[.\s]*P[.\-:\s]+([0-9]{2,3})\b", r"(?i)\(\s*HP[-:\s]*([0-9]{2,3})\s*\)", r"(?i)\b([0-9]{2,3})\s*H[.\s]*P\b", r"(?i)\b([0-9]{2,3})HP\b")


def hp_from_text(text: Column) -> Column:
    """Horse power written inside a model name: the first of four patterns with a value in range."""
    lo, hi = HP_RANGE
    found = [F.regexp_extract(text, p, 1).try_cast("int") for p in HP_FORMS]
    return F.coalesce(*(F.when(v.between(lo, hi), v) for v in found))


def relevance(text: Column) -> Column:
    """Weighted keyword counts with diminishing returns, and half a point for each of up to six long numbers."""
    low = F.lower(text)
    total = F.lit(0.0)
    for word, weight in RELEVANCE:
        n = F.floor((F.char_length(low) - F.char_length(F.replace(low, F.lit(word), F.lit("")))) / len(word))
        total = total + F.when(n > 0, weight * (1.0 + 0.4 * (n - 1))).otherwise(0.0)
    numbers = F.size(F.regexp_extract_all(low, F.lit(r"\b[0-9]{4,8}\b"), F.lit(0)))
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, 0.0).otherwise(total + F.least(numbers, F.lit(6)) * 0.5)


def json_blob(raw: Column) -> Column:
    """From the first opening to the last closing brace, if that is a JSON object."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    # the parser stops at the object's end, so what follows a closing brace is held against the grammar here
    bare = F.regexp_replace(found, r'"(?:[^"\\\\]|\\\\.)*"', "")
    level = F.char_length(F.regexp_replace(bare, r"[^{]", "")) == F.char_length(F.regexp_replace(bare, r"[^}]", ""))
    return F.when((found != "") & level & ~bare.rlike(r"\}\s*[^,}\]\s]") & F.json_object_keys(found).isNotNull(), found)


def quoted(literal: str) -> str:
    """A literal as a pattern."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def plain_key(text: Column) -> Column:
    """White space to single spaces, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def inr(amount: Column, sign: str = "₹") -> Column:
    """Rupees with the last three digits and then pairs set apart, behind ``sign``; a dash for null."""
    digits = F.abs(amount).cast("string")
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(digits, F.lit(1), F.char_length(digits) - 3)), r"([0-9]{2})(?=[0-9])", "$1,"))
    shown = F.when(F.char_length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.substring(digits, -3, 3)))
    return F.when(amount.isNull(), "—").otherwise(F.concat(F.lit(sign), F.when(amount < 0, "-").otherwise(""), shown))


def size_kb(n: Column) -> Column:
    """Kilobytes with two digits; halves go to the even digit."""
    return F.format_string("%.2f KB", F.bround(n / F.lit(1024.0), 2))


def filename_bucket(stem: Column) -> Column:
    """Where a file came from, by the form of its name."""
    low = F.lower(stem)
    return F.when(low.startswith("android"), "android").when(low.startswith("others"), "others").when(stem.rlike("^[0-9]{9,}$"), "numeric").otherwise("named")


def text_of(tokens: Column) -> Column:
    """The texts of an array of (tok_idx, text), in order, joined by spaces."""
    return F.concat_ws(" ", F.transform(F.array_sort(tokens), lambda t: t["text"]))


def coerce_int(literal: Column) -> Column:
    """A number from a JSON literal: whole as it is, fractions cut, digits of a string; booleans and the rest are null."""
    low = F.btrim(literal)
    number = F.when(low.rlike(r"^-?[0-9]+$"), low.try_cast("bigint")).when(low.rlike(r"^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$"), low.try_cast("double").try_cast("bigint"))
    return F.when(low.rlike('^".*"$'), to_int(low)).otherwise(number)


def manual_int(text: Column) -> Column:
    """What a person typed: thousands separators and currency marks are dropped, anything else makes it null."""
    return F.btrim(F.regexp_replace(text, r",|₹|(?i:rs\.?)", "")).try_cast("bigint")


def wanted_fields(fields: Column) -> Column:
    """The known ones of the requested fields, in the order of the request."""
    known = F.array(*map(F.lit, ("dealer_name", "model_name", "horse_power", "asset_cost")))
    return F.array_intersect(fields, known)


def prompt(text: Column, fields: Column) -> Column:
    """What a language model is asked: the page's text and the missing fields as a JSON list."""
    return F.concat(F.lit("Text of the page:\n"), text, F.lit("\n\nAnswer with a JSON object of these fields: "), F.to_json(wanted_fields(fields)))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that gives at least one, with one digit."""
    units = ("B", "KB", "MB", "GB", "TB")
    level = F.least(F.lit(len(units) - 1), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10 + 1e-9))
    return F.format_string("%.1f %s", n / F.pow(F.lit(1024.0), level), F.element_at(F.array(*map(F.lit, units)), (level + 1).cast("int")))
