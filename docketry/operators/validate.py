"""The result's schema as a check: what in a line of JSON does not belong, is out of range or badly formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = ("doc_id", "fields", "confidence", "processing_time_sec", "cost_estimate_usd", "error")
VALUED = {"dealer_name": "string", "model_name": "string", "horse_power": "int", "asset_cost": "int"}
VISUAL = ("signature", "stamp")


def _members(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def _extra(members: Column, allowed: tuple[str, ...], at: str) -> Column:
    return F.transform(F.array_sort(F.array_except(F.map_keys(members), F.array(*map(F.lit, allowed)))), lambda k: F.concat(F.lit(f"extra:{at}"), k))


def _unit(members: Column, at: str) -> Column:
    value = F.try_element_at(members, F.lit("confidence")).try_cast("double")
    return F.when(~F.coalesce(value.between(0, 1), F.lit(False)), f"confidence:{at}")


def _whole(text: Column) -> Column:
    return text.rlike("^-?[0-9]+$")


def _box(members: Column, at: str) -> Column:
    """A box is null or four whole numbers, left before right and top before bottom."""
    text = F.try_element_at(members, F.lit("bbox"))
    items = F.from_json(text, "array<string>")
    numbers = F.transform(items, lambda v: v.try_cast("long"))
    sound = (F.size(items) == 4) & F.forall(items, _whole) & (F.get(numbers, 0) < F.get(numbers, 2)) & (F.get(numbers, 1) < F.get(numbers, 3))
    return F.when(text.isNotNull() & ~F.coalesce(sound, F.lit(False)), f"bbox:{at}")


def faults(lines: DataFrame) -> DataFrame:
    """``lines`` (value) with ``faults``: unreadable; extra:PATH of keys that the schema lacks, missing:FIELD, confidence:FIELD of
    those outside [0, 1], value:FIELD of those of another type, bbox:FIELD of bad boxes. An empty array is a sound record."""
    top = _members(F.col("value"))
    fields = _members(F.try_element_at(F.col("_top"), F.lit("fields")))
    read = lines.withColumn("_top", top).withColumn("_fields", fields)
    found = [_extra(F.col("_top"), TOP, ""), _extra(F.col("_fields"), (*VALUED, *VISUAL), "fields.")]
    single = []
    for name in (*VALUED, *VISUAL):
        own = F.try_element_at(F.col("_fields"), F.lit(name))
        members, there = _members(own), own.isNotNull()
        allowed = ("value", "confidence") if name in VALUED else ("present", "bbox", "confidence")
        found.append(F.when(there, _extra(members, allowed, f"fields.{name}.")))
        single += [F.when(~there, f"missing:{name}"), F.when(there, _unit(members, name))]
        if name in VISUAL:
            single += [F.when(there & ~F.coalesce(F.try_element_at(members, F.lit("present")).isin("true", "false"), F.lit(False)), f"value:{name}"), F.when(there, _box(members, name))]
        elif VALUED[name] == "int":
            said = F.try_element_at(members, F.lit("value"))
            single.append(F.when(said.isNotNull() & ~_whole(said), f"value:{name}"))
    none = F.array().cast("array<string>")
    listed = F.concat(*(F.coalesce(f, none) for f in found), F.array_compact(F.array(*single)))
    broken = F.col("_top").isNull() | F.col("_fields").isNull()
    return read.withColumn("faults", F.when(broken, F.array(F.lit("unreadable"))).otherwise(listed)).drop("_top", "_fields")
