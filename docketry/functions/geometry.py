"""Boxes: rows, distances, overlap and normalised coordinates. A box is a struct with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_TOLERANCE = 30


def middle(box: Column) -> Column:
    return (box["y1"] + box["y2"]) / 2


def same_row(a: Column, b: Column) -> Column:
    return F.abs(middle(a) - middle(b)) <= ROW_TOLERANCE


def same_row_or_after(anchor: Column, other: Column) -> Column:
    """On the anchor's row and not left of it by more than 5 px, or on a lower row."""
    return F.when(same_row(anchor, other), other["x1"] >= anchor["x1"] - 5).otherwise(middle(other) > middle(anchor))


def distance(a: Column, b: Column) -> Column:
    """Between centres, rounded half to even."""
    dx = (a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
    dy = middle(a) - middle(b)
    return F.rint(F.sqrt(dx * dx + dy * dy))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0), box["x2"] - box["x1"]) * F.greatest(F.lit(0), box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = w * h
    return shared / F.greatest(F.lit(1), area(a) + area(b) - shared)


def quad_box(quad: Column) -> Column:
    """The axis-parallel box of an array of (x, y), rounded half to even, clipped at zero; null if it has no area."""
    side = lambda f, k: f(F.transform(quad, lambda p: F.rint(p[k]).cast("int")))
    x1, y1, x2, y2 = side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")
    box = F.struct(*(F.greatest(F.lit(0), v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)))
    return F.when((x2 > x1) & (y2 > y1), box)


def to_yolo(box: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size as shares of the image."""
    return [(box["x1"] + box["x2"]) / 2 / width, (box["y1"] + box["y2"]) / 2 / height, (box["x2"] - box["x1"]) / width, (box["y2"] - box["y1"]) / height]


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.struct(*(v.cast("int").alias(n) for n, v in (("x1", (cx - w / 2) * width), ("y1", (cy - h / 2) * height), ("x2", (cx + w / 2) * width), ("y2", (cy + h / 2) * height))))


def well_formed(box: Column) -> Column:
    return box.isNull() | ((box["x1"] < box["x2"]) & (box["y1"] < box["y2"]))
