"""Page images (rows of ``sources.images``): levels and skew, clean-up before recognition, outlines of stamps and signatures.

A page is one row and is handled on its own; pages without pixels (``error``) give no row. All rows keep ``path``,
``name`` and ``page_index``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import imaging as I
from docketry.operators import detections
from docketry.sources.images import BATCH_BYTES

KEY = ("path", "name", "page_index")
OUTLINE = "seq long, x int, y int, w int, h int, area double, arc double, density double, page_w int, page_h int"


def _by_page(pages: DataFrame, make: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """The key and the rows of ``schema`` that ``make`` gets from the RGB of each page."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, seen = [], [], 0
            for i in range(batch.num_rows):
                width, height, pixels = (batch.column(len(KEY) + k)[i].as_py() for k in range(3))
                made = make(np.frombuffer(pixels, np.uint8).reshape(height, width, 3))
                rows, of, seen = rows + made, of + [i] * len(made), seen + len(pixels)
                if seen >= BATCH_BYTES or i + 1 == batch.num_rows:  # a batch of its own costs a small page as much as its work
                    own = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(len(KEY))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [*KEY, *names])
                    rows, of, seen = [], [], 0

    whole = pages.where("pixels is not null").select(*KEY, "width", "height", "pixels")
    return whole.mapInArrow(run, f"path string, name string, page_index int, {schema}")


def levels(pages: DataFrame) -> DataFrame:
    """red, green and blue (sums of samples), the threshold between dark and light, and the skew in degrees of each page."""

    def make(rgb: np.ndarray) -> list[tuple]:
        grey = I.grey(rgb)
        level = I.otsu(grey)
        sums = rgb.reshape(len(rgb), -1).sum(axis=0, dtype=np.int64).reshape(-1, 3).sum(axis=0)  # rows first: they lie together
        return [(*(int(s) for s in sums), level, I.skew(grey, level=level))]

    return _by_page(pages, make, "red long, green long, blue long, threshold int, skew double")


def preprocessed(pages: DataFrame, noise: float = 5.0) -> DataFrame:
    """Each page turned straight (by 0.5 to 10 degrees; ``turned`` says by how many), freed of noise (``noise`` 0: not) and
    its contrast equalised on the luminance: width, height, pixels."""

    def make(rgb: np.ndarray) -> list[tuple]:
        straight, angle = I.deskewed(rgb)
        planes = I.split_luminance(straight)
        if noise:
            planes = tuple(I.denoised(p, noise) for p in planes)
        made = I.join_luminance(I.equalised(planes[0]), *planes[1:])
        return [(angle, made.shape[1], made.shape[0], made.tobytes())]

    return _by_page(pages, make, "turned double, width int, height int, pixels binary")


def stamp_outlines(pages: DataFrame, least_side: int = 20) -> DataFrame:
    """Outlines of closed patches of coloured ink, in ``detections.stamp_shapes``' terms, with ``doc_id`` the page's name and
    number. Patches whose box is narrower than ``least_side`` are no stamp and are not followed."""

    def make(rgb: np.ndarray) -> list[tuple]:
        ink = I.stamp_ink(rgb)
        found = I.outlines(I.closed(ink, I.ellipse(9), 2), (least_side, least_side)) if ink.any() else []
        return [(k, *o, None, rgb.shape[1], rgb.shape[0]) for k, o in enumerate(found)]

    return _named(_by_page(pages, make, OUTLINE))


def signature_outlines(pages: DataFrame, least_side: tuple[int, int] = (60, 15)) -> DataFrame:
    """Outlines of joined dark strokes in the lower part of the page, with the share of ink in their box, for
    ``detections.signature_shapes``."""

    def make(rgb: np.ndarray) -> list[tuple]:
        top, left = int(rgb.shape[0] * 0.55), int(rgb.shape[1] * 0.05)
        strokes = I.dark_strokes(I.grey(rgb)[top:, left:])
        found = I.outlines(I.closed(strokes, [7] * 5, 2), least_side)
        return [(k, x + left, y + top, w, h, area, arc, float(strokes[y : y + h, x : x + w].mean()), rgb.shape[1], rgb.shape[0]) for k, (x, y, w, h, area, arc) in enumerate(found)]

    return _named(_by_page(pages, make, OUTLINE))


def _named(outlines: DataFrame) -> DataFrame:
    return outlines.withColumn("doc_id", F.concat_ws("#", "name", "page_index"))


def found_marks(pages: DataFrame, stamps: int = 2, signatures: int = 1) -> DataFrame:
    """Detections of stamps and signatures on the pages: the best of each by shape, signatures off the stamps kept."""
    of_stamps = detections.top_per_class(detections.stamp_shapes(stamp_outlines(pages)), {"stamp": stamps})
    drawn = detections.signature_shapes(signature_outlines(pages), of_stamps)
    return of_stamps.unionByName(detections.top_per_class(drawn, {"signature": signatures}))
