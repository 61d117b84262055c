"""Text features and linear classifiers for the classifier operators.

Classifiers are softmax regressions. A fit is a distributed one: training rows lie in a written table of features,
each pass sums losses and gradients of all of them on the executors, and the driver holds weights and its own
optimizer's vectors only, whose size does not depend on the rows. Several problems share the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm import vec

DIMS = 1 << 17
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20
_UPPER, _DIGIT, _SIGN, _PIPE, _LINE = (np.zeros(256, np.uint8) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _PIPE[ord("|")] = _LINE[10] = 1
_SIGN[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = 1
STATS = 8


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all words (ASCII punctuation parts words), row offsets, and per-row statistics."""
    w = vec.Words(_PLAIN[data], offsets)
    ids = (vec.xxh64(w.buf, w.start, w.end - w.start, 7) & np.uint64(DIMS - 1)).astype(np.int64)
    n = np.maximum(np.diff(w.rows), 1)
    size = np.maximum(np.diff(offsets), 1)
    per = lambda t: vec.row_sums(t[data], offsets, np.int64)
    own = np.sort(np.repeat(np.arange(len(n)), np.diff(w.rows)) * DIMS + ids)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    distinct = np.bincount(own[new] // DIMS, minlength=len(n))
    stats = [np.log1p(np.diff(w.rows)), per(_UPPER) / size, per(_DIGIT) / size, per(_SIGN) / size, per(_PIPE) / n, per(_LINE) / n, distinct / n, np.minimum(size / n, 40)]
    return ids, w.rows, np.stack(stats, axis=1)


def bag(column: pa.Array | pa.ChunkedArray) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Each row's distinct buckets, their counts, and statistics; bounded by ``DIMS`` a row. Texts are worked on in pieces of a
    batch, so that what is held beside them does not grow with it."""
    data, offsets = vec.flat(column)
    keys, counts, stats = [], [], [np.zeros((0, STATS))]
    for a, b in vec.pieces(offsets, PIECE):
        own = bag_of(*token_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        keys += own[0]
        counts += own[1]
        stats.append(own[2])
    return keys, counts, np.concatenate(stats)


def bag_of(ids: np.ndarray, rows: np.ndarray, stats: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
    own = np.sort(np.repeat(np.arange(len(rows) - 1), np.diff(rows)) * DIMS + ids)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(own))).astype("<i4")
    key, at = (own[first] % DIMS).astype("<i4"), np.searchsorted(own[first], np.arange(len(rows)) * DIMS)
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return cut(key), cut(count), stats


PIECE = 1 << 21  # bytes of texts of a batch that are worked on at once
PART = 1 << 19  # entries of a batch that are worked on at once


class Bags:
    """Sparse rows: ``at`` row offsets over ``key`` and ``value`` = count / sqrt(words)."""

    def __init__(self, keys: pa.Array, counts: pa.Array):
        self.at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in keys.to_pylist()])]).astype(np.int64)
        joined = lambda column: np.frombuffer(b"".join(column.to_pylist()), "<i4")
        self.key, count = joined(keys), joined(counts)
        n = np.maximum(vec.row_sums(count, self.at), 1)
        self.value = count / np.sqrt(np.repeat(n, np.diff(self.at)))

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Each row's sum of value times ``table[key]``, for all columns of the table."""
        out = np.empty((len(self.at) - 1, table.shape[1]))
        for c in range(table.shape[1]):
            out[:, c] = vec.row_sums(self.value * table[self.key, c], self.at)
        return out

    def spread(self, rows: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
        """For each key the sum of value times its rows' columns: the transpose of ``dot``."""
        value, n = self.value if value is None else value, np.diff(self.at)
        return np.stack([np.bincount(self.key, value * np.repeat(rows[:, c], n), minlength=DIMS) for c in range(rows.shape[1])], axis=1)


class Linear:
    """Softmax regression over hashed words (none if ``words`` is None) and scaled dense columns."""

    def __init__(self, classes: int, width: int, words: bool):
        self.words = np.zeros((DIMS, classes), np.float32) if words else None
        self.dense = np.zeros((width + 1, classes))
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def columns(self, dense: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((dense - self.mean) / self.scale, -4, 4), np.ones((len(dense), 1))], axis=1)

    def logits(self, dense: np.ndarray, bags: Bags | None = None) -> np.ndarray:
        z = self.columns(dense) @ self.dense
        return z if self.words is None else z + bags.dot(self.words)

    def score_tokens(self, ids: np.ndarray, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Logits of whole texts straight from their tokens."""
        n = np.maximum(np.diff(rows), 1)
        return self.columns(dense) @ self.dense + vec.row_sums(self.words[ids], rows, np.float64) / np.sqrt(n)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Problem:
    """``label``: the column of class numbers, null where a row does not take part. ``dense``: the binary column of ``width`` doubles."""

    label: str
    classes: int
    dense: str
    width: int
    words: bool
    decay: float


SLICES = 8


def summed(rows: DataFrame, vector: Callable[[pa.RecordBatch], np.ndarray], few: bool = False) -> np.ndarray:
    """The sum over all batches of ``rows`` of ``vector(batch)``: a task sums its own, tasks meet slice by slice.

    With ``few``, for long vectors, files are read by two tasks a core, so that vectors grow with the cores, not the files.
    """
    if few:
        rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = vector(batch)
            total = own if total is None else total + own
        if total is not None:
            parts = np.array_split(total, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = 0.0
        for part in group.column("part"):
            total = total + np.frombuffer(part.as_py())
        return pa.table({"slice": group.column("slice").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, part binary"
    found = rows.mapInArrow(run, kind).repartition(SLICES, "slice").groupBy("slice").applyInArrow(add, kind).toArrow().sort_by("slice")
    return np.frombuffer(b"".join(found.column("part").to_pylist()))


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch of features with about ``PART`` entries."""
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in batch.column("keys").to_pylist()])])
    for a, b in vec.pieces(at, PART):
        yield batch.slice(a, b - a)


def labels_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Class numbers, -1 for null."""
    return batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def dense_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), "<f8").reshape(batch.num_rows, -1)


class Descent:
    """L-BFGS with backtracking: ``point`` is to be evaluated next, ``best`` the lowest point so far."""

    def __init__(self, start: np.ndarray, memory: int = 6):
        self.point = self.best = start
        self.value, self.memory, self.pairs = None, memory, []

    def told(self, value: float, slope: np.ndarray) -> None:
        if self.value is not None and value > self.value + 1e-4 * self.step * self.fall:
            self.step *= 0.3
            self.point = self.best + self.step * self.way
            return
        if self.value is not None:
            s, y = self.point - self.best, slope - self.slope
            if s @ y > 1e-12:
                self.pairs = [*self.pairs[1 - self.memory :], (s, y, 1 / (s @ y))]
        self.best, self.value, self.slope = self.point, value, slope
        q, used = slope.copy(), []
        for s, y, r in reversed(self.pairs):
            used.append(r * (s @ q))
            q -= used[-1] * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(used), strict=True):
            q += (a - r * (y @ q)) * s
        self.way, self.fall = -q, -(slope @ q)
        self.step = 1.0 if self.pairs else 1 / max(np.sqrt(slope @ slope), 1e-12)
        self.point = self.best + self.step * self.way


def fit(rows: DataFrame, problems: list[Problem], models: list[Linear], passes: int) -> list[Linear]:
    """Models of ``problems`` over the features ``rows`` (keys, counts, dense and label columns), from ``models`` on.

    Minimises the mean cross-entropy plus decay times half the squared weights. A word's weight is a multiple of its
    log-odds of occurring in a class, so that words that tell classes apart move first; words in fewer than three
    rows have none. The first pass gathers these and the scale of the dense columns, ``passes`` more descend.
    """
    spark, sizes = rows.sparkSession, [(DIMS * p.classes if p.words else 0, (p.width + 1) * p.classes) for p in problems]

    def statistics(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(p.classes + 2 * p.width + (DIMS * p.classes if p.words else 0)) for p in problems]
        for piece in pieces_of(batch):
            for p, own in zip(problems, out, strict=True):
                y = labels_of(piece, p.label)
                x, truth = dense_of(piece, p.dense), np.eye(p.classes)[np.maximum(y, 0)] * (y >= 0)[:, None]
                if (y >= 0).any():
                    own[: p.classes] += truth.sum(axis=0)
                    own[p.classes : p.classes + p.width] += x[y >= 0].sum(axis=0)
                    own[p.classes + p.width : p.classes + 2 * p.width] += (x[y >= 0] ** 2).sum(axis=0)
                    if p.words:
                        bags = Bags(piece.column("keys"), piece.column("counts"))
                        own[p.classes + 2 * p.width :] += bags.spread(truth, np.ones(len(bags.key))).ravel()
        return np.concatenate(out)

    found, at = summed(rows, statistics, few=True), 0
    if not len(found):
        return models
    counts, ratios, made, descents = [], [], [], []
    for p, old in zip(problems, models, strict=True):
        end = at + p.classes + 2 * p.width + (DIMS * p.classes if p.words else 0)
        own, at = found[at:end], end
        size = own[: p.classes]
        n = max(size.sum(), 1.0)
        new = Linear(p.classes, p.width, p.words)
        new.mean = own[p.classes : p.classes + p.width] / n
        new.scale = np.sqrt(np.maximum(own[p.classes + p.width : p.classes + 2 * p.width] / n - new.mean**2, 0)) + 1e-6
        # the old weights in terms of the new scale
        new.dense[:-1] = old.dense[:-1] * (new.scale / old.scale)[:, None]
        new.dense[-1] = old.dense[-1] + ((new.mean - old.mean) / old.scale) @ old.dense[:-1]
        ratio, start = None, new.dense.ravel()
        if p.words:
            held = own[p.classes + 2 * p.width :].reshape(DIMS, p.classes)
            often, held = held.sum(axis=1) >= 3, held + 1.0
            other, total = held.sum(axis=1, keepdims=True) - held, size + 2.0
            ratio = np.clip(np.log(held / total) - np.log(other / (total.sum() - total)), -6, 6) * often[:, None] if p.classes > 1 else np.zeros_like(held)
            start = np.concatenate([np.divide(old.words, ratio, out=np.zeros_like(ratio), where=np.abs(ratio) > 1e-3).ravel(), start])
        counts.append(n)
        ratios.append(ratio)
        made.append(new)
        descents.append(Descent(start))

    def place(model: Linear, p: Problem, ratio: np.ndarray | None, point: np.ndarray, size: tuple[int, int]) -> Linear:
        if p.words:
            model.words = (point[: size[0]].reshape(DIMS, p.classes) * ratio).astype(np.float32)
        model.dense = point[size[0] :].reshape(-1, p.classes)
        return model

    for _ in range(passes):
        for p, model, ratio, size, d in zip(problems, made, ratios, sizes, descents, strict=True):
            place(model, p, ratio, d.point, size)
        held = spark.sparkContext.broadcast(made)

        def slopes(batch: pa.RecordBatch, held=held) -> np.ndarray:
            out = [np.zeros(1 + sum(s)) for s in sizes]
            for piece in pieces_of(batch):
                bags = Bags(piece.column("keys"), piece.column("counts")) if any(p.words for p in problems) else None
                for p, model, own, size in zip(problems, held.value, out, sizes, strict=True):
                    y = labels_of(piece, p.label)
                    on = (y >= 0)[:, None]
                    x = dense_of(piece, p.dense)
                    chance, truth = softmax(model.logits(x, bags)), np.eye(p.classes)[np.maximum(y, 0)]
                    error = (chance - truth) * on
                    own[0] -= np.log(np.maximum((chance * truth).sum(axis=1), 1e-300))[on[:, 0]].sum()
                    if p.words:
                        own[1 : 1 + size[0]] += bags.spread(error).ravel()
                    own[1 + size[0] :] += (model.columns(x).T @ error).ravel()
            return np.concatenate(out)

        found, at = summed(rows, slopes, few=True), 0
        held.destroy()
        for p, n, ratio, size, d in zip(problems, counts, ratios, sizes, descents, strict=True):
            own, at = found[at : at + 1 + sum(size)] / n, at + 1 + sum(size)
            slope = own[1:].copy()
            if p.words:
                slope[: size[0]] *= ratio.ravel()
            d.told(own[0] + p.decay / 2 * (d.point @ d.point), slope + p.decay * d.point)
    return [place(model, p, ratio, d.best, size) for p, model, ratio, size, d in zip(problems, made, ratios, sizes, descents, strict=True)]
