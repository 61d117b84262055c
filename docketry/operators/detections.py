"""Visual detections: thresholds, best per class, spatial anti-join and ordered deduplication, label rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.geometry import from_yolo, iou, to_yolo
from docketry.sources.shared import written

THRESHOLDS = {"signature": 0.20, "stamp": 0.25}
BOX = ("x1", "y1", "x2", "y2")
CLASSES = ("signature", "stamp")


def confident(detections: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    least = F.lit(None).cast("double")
    for cls, at in (thresholds or THRESHOLDS).items():
        least = F.when(F.col("cls") == cls, at).otherwise(least)
    return detections.where(F.col("conf") >= least)


def best_per_class(detections: DataFrame) -> DataFrame:
    """The most confident detection of each document and class, the first (by ``seq``) of equals."""
    top = F.max_by(F.struct(*BOX, "conf", "seq"), F.struct("conf", -F.col("seq")))
    return detections.groupBy("doc_id", "cls").agg(top.alias("d")).select("doc_id", "cls", "d.*")


def top_per_class(detections: DataFrame, most: dict[str, int]) -> DataFrame:
    """At most ``most[cls]`` detections of each document and class."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "cls").orderBy(F.desc("conf"), "seq"))
    allowed = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))
    return detections.withColumn("rank", rank).where(F.col("rank") <= F.element_at(allowed, F.col("cls")))


def box(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in BOX))


def without_overlap(left: DataFrame, right: DataFrame, most: float = 0.3, cell: int = 256) -> DataFrame:
    """Rows of ``left`` that overlap no box of ``right`` of the same document by more than ``most``.

    Boxes meet through the grid cells that they cover, so a document with many boxes is not compared pair by pair.
    """
    cells = lambda b: F.explode(F.flatten(F.transform(F.sequence(F.floor(b["x1"] / cell), F.floor(b["x2"] / cell)), lambda x: F.transform(F.sequence(F.floor(b["y1"] / cell), F.floor(b["y2"] / cell)), lambda y: F.struct(x, y)))))
    a = left.select("doc_id", "seq", box().alias("a")).withColumn("cell", cells(F.col("a")))
    b = right.select("doc_id", box().alias("b")).withColumn("cell", cells(F.col("b")))
    covered = a.join(b, ["doc_id", "cell"]).where(iou(F.col("a"), F.col("b")) > most).select("doc_id", "seq").distinct()
    return left.join(covered, ["doc_id", "seq"], "left_anti")


KEEP_ROUNDS = 6  # rounds in which all pages are thinned out at once; chains of boxes longer than that go page by page


def keep_first(boxes: DataFrame, most: float = 0.7, valid: Column | None = None, rounds: int = KEEP_ROUNDS) -> DataFrame:
    """doc_id, seq, box and conf of the rows that, in order of ``seq``, overlap no earlier kept row of their document by more
    than ``most``. Rows that are not ``valid`` are kept or left out as any other and push out later ones, but are not returned.

    A round keeps all undecided boxes that no earlier undecided one overlaps, and leaves out those that a kept one
    overlaps. Boxes that overlap so much are nearly of one size and place: they meet by size class and grid cell. A box is
    a row in each cell around it, and packed files tell nothing of that: all sides are shuffled, none goes through the driver.
    """
    is_valid = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    rows = boxes.select("doc_id", "seq", *BOX, "conf", is_valid.alias("ok"))
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    # equal boxes: the first stands for all
    left = rows.where(~flat).groupBy("doc_id", *BOX).agg(F.min_by(F.struct("seq", "conf", "ok"), "seq").alias("r")).select("doc_id", "r.*", *BOX)
    left, done = written(left, "boxes"), [rows.where(flat).select("doc_id", "seq", *BOX, "conf", "ok")]
    level = lambda size: F.floor(F.log2(size))  # noqa: E731  the class of a side
    reach = (1 - most) / most  # two left or upper edges are at most so far apart, in sides

    def home(df: DataFrame, name: str) -> DataFrame:
        w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        cell = lambda at, size: F.floor(at / F.pow(F.lit(2.0), level(size) + 1))
        return df.select("doc_id", F.struct(level(w), level(h), cell(F.col("x1"), w), cell(F.col("y1"), h)).alias("cell"), F.struct("seq", *BOX).alias(name))

    def around(df: DataFrame, name: str) -> DataFrame:
        def axis(at: str, to: str) -> Column:
            size = F.col(to) - F.col(at)
            classes = F.sequence(level(size * most), level(size / most))
            cells = lambda c: F.transform(F.sequence(F.floor((F.col(at) - reach * size) / F.pow(F.lit(2.0), c + 1)), F.floor((F.col(at) + reach * size) / F.pow(F.lit(2.0), c + 1))), lambda k: F.struct(c.alias("c"), k.alias("k")))
            return F.flatten(F.transform(classes, cells))

        spots = df.select("doc_id", F.struct("seq", *BOX).alias(name), F.explode(axis("x1", "x2")).alias("x"), axis("y1", "y2").alias("ys"))
        spots = spots.select("doc_id", name, "x", F.explode("ys").alias("y"))
        return spots.select("doc_id", F.struct("x.c", "y.c", "x.k", "y.k").alias("cell"), name)

    for _ in range(rounds):
        if left.isEmpty():
            break
        meet = (F.col("h.doc_id") == F.col("a.doc_id")) & (F.col("h.cell") == F.col("a.cell")) & (iou(F.col("one"), F.col("other")) > most)
        late = home(left, "one").alias("h").join(around(left, "other").hint("merge").alias("a"), meet & (F.col("other.seq") < F.col("one.seq")), "left_semi").select("doc_id", "one.seq").hint("merge")
        first = written(left.join(late, ["doc_id", "seq"], "left_anti"), "kept")
        done.append(first.select(*done[0].columns))
        out = home(left, "one").alias("h").join(around(first, "other").hint("merge").alias("a"), meet, "left_semi").select("doc_id", "one.seq").hint("merge")
        left = written(left.join(out, ["doc_id", "seq"], "left_anti"), "boxes")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    if not left.isEmpty():
        def thin(page: pd.DataFrame) -> pd.DataFrame:
            return page.sort_values("seq").iloc[first_boxes(page.sort_values("seq")[list(BOX)].to_numpy(), most)]

        found = found.unionByName(left.select(*found.columns).groupBy("doc_id").applyInPandas(thin, found.schema))
    return found.where("ok").drop("ok")


def first_boxes(boxes: np.ndarray, most: float) -> list[int]:
    """Places of the boxes (x1, y1, x2, y2, in order) that overlap no earlier kept one by more than ``most``: each kept box is
    in one cell of a grid for its size class, and a box looks only where one of about its size and place can be."""
    grid: dict[tuple, list[tuple]] = {}
    kept, reach = [], (1 - most) / most
    level = lambda size: math.floor(math.log2(size))
    for k, (x1, y1, x2, y2) in enumerate(boxes.tolist()):
        w, h, near = x2 - x1, y2 - y1, False
        for a in range(level(w * most), level(w / most) + 1):
            for b in range(level(h * most), level(h / most) + 1):
                p, q = 2.0 ** (a + 1), 2.0 ** (b + 1)
                for i in range(math.floor((x1 - reach * w) / p), math.floor((x1 + reach * w) / p) + 1):
                    for j in range(math.floor((y1 - reach * h) / q), math.floor((y1 + reach * h) / q) + 1):
                        for u1, v1, u2, v2 in grid.get((a, b, i, j), ()):
                            shared = max(0, min(x2, u2) - max(x1, u1)) * max(0, min(y2, v2) - max(y1, v1))
                            near = near or shared / max(1, w * h + (u2 - u1) * (v2 - v1) - shared) > most
        if not near:
            kept.append(k)
            a, b = level(w), level(h)
            grid.setdefault((a, b, math.floor(x1 / 2.0 ** (a + 1)), math.floor(y1 / 2.0 ** (b + 1))), []).append((x1, y1, x2, y2))
    return kept


def yolo_lines(detections: DataFrame, width: int, height: int) -> DataFrame:
    """doc_id, seq and line ``cls cx cy w h`` with six decimals."""
    cls = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("cls")).cast("int") - 1
    parts = to_yolo(box(), F.lit(float(width)), F.lit(float(height)))
    return detections.where(F.col("cls").isin(*CLASSES)).select("doc_id", "seq", F.format_string("%d %.6f %.6f %.6f %.6f", cls, *parts).alias("line"))


def parse_yolo(lines: DataFrame) -> DataFrame:
    """``lines`` with cls, cx, cy, w, h and an array of issues."""
    parts, numbers = F.col("_parts"), ("cx", "cy", "w", "h")
    rows = lines.withColumn("_parts", F.split(F.btrim("line"), r"\s+"))  # a column of its own, so that a line is split once
    rows = rows.withColumns({"cls": F.get(parts, F.lit(0)).try_cast("int")} | {name: F.get(parts, F.lit(k)).try_cast("double") for k, name in enumerate(numbers, 1)})
    five, inside = F.size(parts) == 5, F.lit(True)
    for c in ("cls", *numbers):
        five = five & F.col(c).isNotNull()
    for c in numbers:
        inside = inside & F.col(c).between(0, 1)
    rows = rows.withColumns({"_five": five, "_known": F.col("cls").isin(0, 1), "_inside": inside})
    some = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    issues = F.when(F.coalesce("_five", F.lit(False)), F.when(F.col("_known") & F.col("_inside"), some()).when(F.col("_known"), some("range")).when(F.col("_inside"), some("class")).otherwise(some("class", "range")))
    return rows.withColumn("issues", issues.otherwise(some("malformed"))).drop("_parts", "_five", "_known", "_inside")


def yolo_report(parsed: DataFrame) -> DataFrame:
    """Counts of lines, boxes by class and issues."""
    has = lambda x: F.count_if(F.array_contains("issues", x))
    return parsed.agg(F.count("*").alias("lines"), F.count_if((F.size("issues") == 0) & (F.col("cls") == 0)).alias("signatures"), F.count_if((F.size("issues") == 0) & (F.col("cls") == 1)).alias("stamps"), has("malformed").alias("malformed"), has("class").alias("bad_class"), has("range").alias("bad_range"))


def annotation_summary(detections: DataFrame) -> DataFrame:
    """Documents with a signature, a stamp, both or neither."""
    docs = detections.groupBy("doc_id").agg(F.bool_or(F.col("cls") == "signature").alias("sig"), F.bool_or(F.col("cls") == "stamp").alias("st"))
    return docs.agg(F.count_if("sig").alias("with_sig"), F.count_if("st").alias("with_stamp"), F.count_if(F.col("sig") & F.col("st")).alias("both"), F.count_if(~F.col("sig") & ~F.col("st")).alias("neither"))


def pixels(parsed: DataFrame, width: int, height: int) -> DataFrame:
    return parsed.where(F.size("issues") == 0).withColumn("box", from_yolo(*map(F.col, ("cx", "cy", "w", "h")), F.lit(float(width)), F.lit(float(height))))


def by_confidence(detections: DataFrame) -> DataFrame:
    """``detections`` with ``place`` on their page, from 1, the most confident first, the earlier (by ``seq``) of equals."""
    return detections.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("conf"), "seq")))


def _padded(contours: DataFrame, cls: str, score: Column, pad: int) -> DataFrame:
    box = [F.greatest(F.lit(0), F.col("x") - pad), F.greatest(F.lit(0), F.col("y") - pad), F.least(F.col("page_w"), F.col("x") + F.col("w") + pad), F.least(F.col("page_h"), F.col("y") + F.col("h") + pad)]
    return contours.select("doc_id", "seq", F.lit(cls).alias("cls"), *(v.cast("int").alias(c) for v, c in zip(box, BOX, strict=True)), F.least(F.lit(1.0), score).alias("conf"))


def stamp_shapes(contours: DataFrame) -> DataFrame:
    """Detections from outlines (doc_id, seq, x, y, w, h, area, arc, page_w, page_h) that look like a stamp: of middling
    size, about as wide as high, and well filled; the better of them the rounder and larger."""
    page, ratio = F.col("page_w") * F.col("page_h"), F.col("w") / F.col("h")
    fits = F.col("area").between(0.0008 * page, 0.05 * page) & (F.col("w") >= 20) & (F.col("h") >= 20) & ratio.between(0.4, 2.5) & (F.col("area") / (F.col("w") * F.col("h") + 1e-9) >= 0.25)
    roundness = F.lit(4 * math.pi) * F.col("area") / (F.col("arc") * F.col("arc") + 1e-9)
    return _padded(contours.where(fits), "stamp", 0.4 + 0.3 * roundness + 0.3 * F.least(F.col("area") / (0.01 * page), F.lit(1.0)), 6)


def signature_shapes(contours: DataFrame, stamps: DataFrame) -> DataFrame:
    """Detections from outlines with ``density``, the share of ink, that look like a signature and lie on no stamp: wide,
    not too dense; the better of them the denser and longer."""
    page, ratio = F.col("page_w") * F.col("page_h"), F.col("w") / F.col("h")
    fits = F.col("area").between(0.0015 * page, 0.04 * page) & (F.col("w") >= 60) & (F.col("h") >= 15) & ratio.between(1.2, 12) & F.col("density").between(0.04, 0.45)
    boxed = contours.where(fits).withColumns({"x1": F.col("x").cast("int"), "y1": F.col("y").cast("int"), "x2": (F.col("x") + F.col("w")).cast("int"), "y2": (F.col("y") + F.col("h")).cast("int")})
    score = 0.3 + 0.4 * F.least(F.col("density") / 0.2, F.lit(1.0)) + 0.3 * F.least(ratio / 4.0, F.lit(1.0))
    return _padded(without_overlap(boxed, stamps), "signature", score, 8)


def detector_settings(text: str | None) -> dict[str, float]:
    """Thresholds by class and the overlap of equal detections, from a detector's YAML text; its defaults without one."""
    found = {"signature": 0.35, "stamp": 0.40, "nms_iou": 0.45}
    inside = ""
    for line in (text or "").splitlines():
        name, _, value = line.partition("#")[0].rstrip().partition(":")
        inside = inside if name[:1] == " " else name.strip()
        name, value = name.strip(), value.strip()
        if value and (name == "nms_iou" or (inside == "confidence_thresholds" and name in CLASSES)):
            found[name] = float(value)
    return found


def issue_head(parsed: DataFrame, most: int = 20) -> DataFrame:
    """The first issues by image and line number, and how many more there are: place, image, issue; place ``most`` + 1 has the rest's number."""
    # the outer generator keeps the optimizer from working out every line's issues in a filter, each part of a line anew
    issues = parsed.select("image", "number", F.explode_outer("issues").alias("issue")).where("issue is not null")
    first = issues.orderBy("image", "number", "issue").limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("image", "number", "issue")))  # ``most`` rows
    rest = parsed.agg((F.sum(F.size("issues")) - most).alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("image"), F.col("n").cast("string").alias("issue"), F.lit(most + 1).alias("place"))
    return placed.select("place", "image", "issue").unionByName(rest.select("place", "image", "issue"))
