"""Master data: mining candidates, star clusters of names, union of assets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.geometry import same_row
from docketry.functions.similarity import token_set, token_set_ratio
from docketry.operators.anchors import beside, has_hits, signed, with_ahead, with_shingles, with_signs
from docketry.sources.shared import kept

SIMILAR = 85
NEAREST = 5
LEAST_COUNT = 2
PART_ROWS = 4000  # names of a part, of which pairs are compared


def brands(assets: DataFrame) -> DataFrame:
    return assets.select("brand").where("brand <> ''").distinct().orderBy("brand")


def candidate_counts(names: DataFrame, least: int = 4) -> DataFrame:
    """name, n and first: distinct trimmed names of at least four characters, with their first ``seq``."""
    return names.select(F.btrim("name").alias("name"), "seq").where(F.char_length("name") >= least).groupBy("name").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def similar_pairs(ranked: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b, score) of all pairs of ``ranked`` (place, name) of token-set ratio ``SIMILAR`` and more, each both ways.

    A pair gets there in one of two ways. Its common words make up most of one side: then one of that side's rarest words,
    without which the others would not be enough, is common, and names meet by such words. Or what is left on both sides
    nearly agrees: then the names are of nearly one length and have nearly the same letters, and names of like length are
    compared letter count by letter count, a block of pairs at a time. Neither loses a pair; only pairs that are left are
    scored.
    """
    split = F.filter(F.array_distinct(F.split("name", r"(?U)\s+")), lambda w: w != "")
    joined = lambda words: F.aggregate(words, F.lit(-1), lambda n, w: n + 1 + F.char_length(w))
    named = kept(ranked.select("place", "name", split.alias("words")).where(F.size("words") > 0).withColumn("size", joined(F.col("words"))))

    spread = named.select("place", "size", F.explode("words").alias("word"))
    counted = spread.join(spread.groupBy("word").agg(F.count("*").alias("n")), "word")
    rare = counted.groupBy("place", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))  # the words of one name
    enough = F.filter(F.sequence(F.lit(1), F.size("words")), lambda t: (200 - SIMILAR) * joined(F.slice("words", t + 1, F.size("words"))) < SIMILAR * F.col("size"))
    probes = rare.select(F.col("place").alias("a"), F.explode(F.slice("words", F.lit(1), F.array_min(enough))).alias("word"))
    met = probes.join(spread.select(F.col("place").alias("b"), "word"), "word").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    names = named.select("place", "name")
    both = met.join(names.select(F.col("place").alias("a"), F.col("name").alias("one")), "a").join(names.select(F.col("place").alias("b"), F.col("name").alias("two")), "b")
    by_words = both.select("a", "b", token_set_ratio(F.col("one"), F.col("two")).alias("score")).where(F.col("score") >= SIMILAR)

    def letters(texts: list[str]) -> np.ndarray:
        bags = np.zeros((len(texts), 64), dtype=np.int16)
        for k, text in enumerate(texts):
            np.add.at(bags[k], np.frombuffer(text.encode("utf-32-le"), np.uint32) % 64, 1)
        return bags

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.own == group.one], group[group.own == group.two]
        same, made = group.one.iloc[0] == group.two.iloc[0], []
        bags = [letters(["".join(dict.fromkeys(n.split())) for n in side.name]) for side in (left, right)]
        size, place, text = right["size"].to_numpy(), right.place.to_numpy(), right.name.to_numpy()
        for k, (at, name, length) in enumerate(zip(left.place, left.name, left["size"], strict=True)):
            near = 100 * np.abs(bags[1] - bags[0][k]).sum(axis=1, dtype=np.int32) <= (100 - SIMILAR) * (size + length)
            near &= place > at if same else True
            made += [(min(at, place[j]), max(at, place[j]), score) for j in np.flatnonzero(near) if (score := token_set(name, text[j])) >= SIMILAR]
        return pd.DataFrame(made, columns=["a", "b", "score"])

    # a length class is so wide that similar names are of one or of neighbouring ones
    sized = named.select("place", "name", "size", F.floor(F.log(F.col("size")) / (math.log((200 - SIMILAR) / SIMILAR) * (1 + 1e-9))).cast("int").alias("band"))
    bands = {r["band"]: -(-r["n"] // part_rows) for r in sized.groupBy("band").agg(F.count("*").alias("n")).collect()}  # one for each class of lengths
    parts = F.create_map(*(F.lit(x).cast("int") for pair in (bands or {0: 1}).items() for x in pair))
    of = lambda band: F.coalesce(F.try_element_at(parts, band), F.lit(0))
    own = sized.withColumn("own", F.struct("band", F.pmod(F.xxhash64("place"), of(F.col("band"))).cast("int").alias("part")))
    others = F.flatten(F.transform(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda c: F.when(of(c) > 0, F.transform(F.sequence(F.lit(0), of(c) - 1), lambda p: F.struct(c.alias("band"), p.alias("part")))).otherwise(F.array().cast("array<struct<band: int, part: int>>"))))
    dealt = own.withColumn("other", F.explode(others))
    text = lambda c: F.concat_ws(":", f"{c}.band", f"{c}.part")
    dealt = dealt.select("place", "name", "size", text("own").alias("own"), F.least(text("own"), text("other")).alias("one"), F.greatest(text("own"), text("other")).alias("two"))
    by_letters = dealt.groupBy("one", "two").applyInPandas(compare, "a long, b long, score double")

    found = by_words.unionByName(by_letters).dropDuplicates(["a", "b"])
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def reached(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(place, root) of ``nodes`` (place): root is the smallest place reached over ``links`` (a, b), taken both ways."""
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = kept(nodes.select("place", F.col("place").alias("root")))
    while True:
        near = both.join(found.select(F.col("place").alias("b"), "root"), "b").groupBy(F.col("a").alias("place")).agg(F.min("root").alias("near"))
        step = found.join(near, "place", "left").select("place", F.col("root").alias("was"), F.least("root", "near").alias("at"))
        jump = found.select(F.col("place").alias("at"), F.col("root").alias("low"))
        step = kept(step.join(jump, "at").select("place", "was", F.least("at", "low").alias("root")))
        found = step.select("place", "root")
        if step.where("root < was").isEmpty():
            return found


def star_clusters(counts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """canonical, aliases and frequency of name clusters, by greedy stars over all names.

    The first seen unclaimed name is a seed and claims its most similar names of token-set ratio 85 and more, at
    most five with itself. A cluster is called by its most frequent, then longest name, of equal ones the seed or
    the most similar, and needs two occurrences. Names that no chain of claims ties are clustered apart.
    """
    place = F.row_number().over(Window.partitionBy("first").orderBy("name")) - 1
    same = counts.groupBy("first").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 1
    ranked = kept(counts.withColumn("place", F.col("first").cast("long") * same + place))
    pairs = similar_pairs(ranked.select("place", "name"), part_rows).unionByName(ranked.select(F.col("place").alias("a"), F.col("place").alias("b"), F.lit(100.0).alias("score")))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    claims = kept(pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEAREST))
    near = claims.groupBy(F.col("a").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]).alias("near"))
    rows = ranked.join(near, "place").join(reached(ranked, claims), "place")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = {r["place"]: r for r in group.sort_values("place").to_dict("records")}
        taken, made = set(), []
        for seed, row in names.items():
            if seed in taken:
                continue
            mine = [seed, *(k for k in row["near"] if k != seed and k not in taken)]
            taken.update(mine)
            total = sum(names[k]["n"] for k in mine)
            if total >= LEAST_COUNT:
                lead = max(mine, key=lambda k: (names[k]["n"], len(names[k]["name"])))
                made.append((names[lead]["name"], sorted(names[k]["name"] for k in mine if k != lead), total))
        return pd.DataFrame(made, columns=["canonical", "aliases", "frequency"])

    return rows.groupBy("root").applyInPandas(run, "canonical string, aliases array<string>, frequency long")


def union_assets(curated: DataFrame, mined: DataFrame) -> DataFrame:
    """brand, model, full_name: curated rows win over mined ones of the same name, earlier over later."""
    both = curated.withColumn("rank", F.lit(0)).unionByName(mined.withColumn("rank", F.lit(1))).withColumn("key", F.lower(F.btrim("full_name")))
    first = Window.partitionBy("key").orderBy("rank", "seq")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1 and key <> ''").select("brand", "model", "full_name")


def harvest_dealers(tokens: DataFrame) -> DataFrame:
    """doc_id and name: the boldest row of each page's top 12 per cent, in capitals, and what follows an anchor."""
    page = Window.partitionBy("doc_id")
    top = tokens.withColumn("height", F.coalesce(F.max("y2").over(page), F.lit(2000))).where(F.col("y1") < F.col("height") * 0.12)
    rows = top.groupBy("doc_id", F.floor(F.col("y1") / 30).alias("line")).agg(F.array_sort(F.collect_list(F.struct("x1", "tok_idx", "text"))).alias("ts"))
    text = F.concat_ws(" ", F.transform("ts", lambda t: t["text"]))
    capitals = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    scored = rows.select("doc_id", "line", F.btrim(text).alias("name"), (capitals + 2 * F.size("ts")).alias("score"))
    bold = scored.groupBy("doc_id").agg(F.max_by("name", F.struct("score", -F.col("line"))).alias("name")).select("doc_id", F.upper("name").alias("name"))
    seen = with_shingles(with_signs(tokens, "dealer_name"), may=signed("dealer_name"))
    begins = F.coalesce(F.when(F.col("may"), has_hits("dealer_name")), F.lit(False))
    framed = with_ahead(seen.select("doc_id", "tok_idx", "me", begins.alias("begins")), 5).where("begins")
    stop = F.array_position(F.transform("ahead", lambda t: t["text"].rlike(f"^{T.NUMBER}$") | ~same_row(F.col("me"), t)), F.lit(True))
    run = F.when(stop > 0, F.slice("ahead", F.lit(1), stop.cast("int") - 1)).otherwise(F.col("ahead"))
    named = framed.select("doc_id", F.concat_ws(" ", F.transform(run, lambda t: t["text"])).alias("name"))
    return bold.unionByName(named).where(F.char_length("name").between(4, 80) & F.col("name").rlike(r"\p{L}"))


def harvest_assets(tokens: DataFrame, brand_names: list[str]) -> DataFrame:
    """Distinct brand, model, full_name: a brand token and up to three more of its row, if the model has a digit."""
    pattern = r"(?i)\b(" + "|".join(map(T.quoted, sorted(brand_names))) + r")\b"
    canonical = F.create_map(*(F.lit(x) for b in brand_names for x in (b.lower(), b)))
    framed = tokens.withColumn("me", F.struct("tok_idx", "text", "x1", "y1", "x2", "y2")).withColumn("ahead", beside(F.col("me"), 1, 3))
    model = F.btrim(F.concat_ws(" ", F.transform(F.filter("ahead", lambda t: same_row(F.col("me"), t)), lambda t: t["text"])))
    found = framed.where(F.col("text").rlike(pattern)).select(F.element_at(canonical, F.lower(F.regexp_extract("text", pattern, 1))).alias("brand"), model.alias("model"))
    return found.where(F.col("model").rlike("[0-9]") & F.char_length("model").between(2, 40)).select("brand", "model", F.concat_ws(" ", "brand", "model").alias("full_name")).distinct()


def most_common(names: DataFrame) -> DataFrame:
    """name, n and place: the most frequent first, of equals the first seen (by ``seq``)."""
    counts = names.groupBy("name").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    # a place for each distinct name of a vocabulary, not for each row
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("name", "n", "place")
