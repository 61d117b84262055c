"""Embedding whitening by an exact integer scatter matrix.

Entries become integers, ``floor(scale * c)``. The fit list holds each distinct integer vector once. A task subtracts a
shift (the first vector that it sees) from its rows and adds up sums and cross-products in integers of any size: in
blocks whose products stay below 2^53 the float unit's results are exact integers, beyond that Python's integers take
over. The shift is taken back exactly, so that tasks can be added: as limbs of 31 bits, which Spark sums as longs. The
driver gets the sums of one matrix (dimensions squared, not rows), forms ``n * X'X - SS'`` exactly, and only then turns
it into doubles and decomposes it by ``eigh``.

Rows whose vector is null, empty or holds null or non-finite entries are dropped. Vectors of each length are a fit of
their own. Repeated rows are returned once each; a null vec_id stays null. An entry beyond the range of a long takes its
end. A component without variance (one row, or fewer dimensions in use) has a null ``whitened``, counts as 0 in
``explained`` (null if nothing varies) and not at all in ``identity_error``. A ``deviation`` of more than 38 digits is
null. An empty table gives no rows. Other columns are ignored, whatever their names. Eigenvectors are given the sign that
makes their largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written

SCALE = 256
COMPONENTS = 4
LIMB = 31  # bits of a limb: sums of two thousand million tasks fit into a long
_KINDS = ("<i1", "<i2", "<i4", "<i8")
_LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int = SCALE, keys: tuple[str, ...] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """``keys`` and ``x`` of the rows with a whole vector: a byte that says how wide an integer is, and the integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(len(keys))
            size = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = pc.fill_null(given.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
            rows = np.flatnonzero((size > 0) & (bad[edge[1:]] == bad[edge[:-1]]))
            with np.errstate(over="ignore", invalid="ignore"):
                f = np.floor(c * scale)
                x = np.where(f >= _LONG, _LONG - 1, np.where(f <= -_LONG, -_LONG, np.where(np.abs(f) < _LONG, f, 0).astype(np.int64)))
            made = []
            for a, b in zip(edge[rows], edge[rows + 1]):
                row = x[a:b]
                k = next(k for k, kind in enumerate(_KINDS) if row.min() >= np.iinfo(kind).min and row.max() <= np.iinfo(kind).max)
                made.append(bytes([k]) + row.astype(_KINDS[k]).tobytes())
            taken = [batch.column(k).take(pa.array(rows)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(made, pa.binary())], [*keys, "x"])

    given = vectors.select(*keys, column)
    kinds = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{kinds}, x binary")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their long matrix, for each length and width of integer."""
    cells = column.to_pylist()
    shape = np.array([len(c) * 4 + c[0] for c in cells], dtype=np.int64)
    for s in np.unique(shape):
        at = np.flatnonzero(shape == s)
        yield at, np.frombuffer(b"".join(cells[i][1:] for i in at), _KINDS[s & 3]).reshape(len(at), -1).astype(np.int64)


def _reach(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


class Scatter:
    """Exact count, sums and cross-products of integer rows, about a shift."""

    def __init__(self, shift: np.ndarray):
        self.shift, self.n, d = shift, 0, len(shift)
        self.s, self.xx = np.zeros(d, object), np.zeros((d, d), object)
        self._s, self._xx, self._bound = np.zeros(d, np.int64), np.zeros((d, d), np.int64), 0

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        if _reach(x) + _reach(self.shift) < 1 << 26:
            y = x - self.shift
            square = max(1, _reach(y)) ** 2
            for i in range(0, len(y), (1 << 53) // square):
                part = y[i : i + (1 << 53) // square].astype(np.float64)
                if self._bound + len(part) * square >= 1 << 62:
                    self._carry()
                self._bound += len(part) * square
                self._xx += (part.T @ part).astype(np.int64)  # every partial sum is an integer below 2^53
                self._s += part.sum(axis=0).astype(np.int64)
        else:
            y = x.astype(object) - self.shift.astype(object)
            self.s += y.sum(axis=0)
            self.xx += y.T @ y

    def _carry(self) -> None:
        self.s += self._s.astype(object)
        self.xx += self._xx.astype(object)
        self._s[:], self._xx[:], self._bound = 0, 0, 0

    def about_zero(self) -> tuple[int, np.ndarray, np.ndarray]:
        """n, S and X'X of the rows themselves."""
        self._carry()
        a = self.shift.astype(object)
        cross = np.outer(self.s, a)
        return self.n, self.s + self.n * a, self.xx + cross + cross.T + self.n * np.outer(a, a)


def limbs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, i, j, limb, part) of a task's scatter: i = -1 holds n (j = -1) and S; the rest is X'X from its diagonal on."""
    sums: dict[int, Scatter] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            sums.setdefault(x.shape[1], Scatter(x[0])).add(x)
    for width, scatter in sums.items():
        n, s, xx = scatter.about_zero()
        up = np.triu_indices(width)
        i = np.concatenate([np.full(width + 1, -1), up[0]])
        j = np.concatenate([np.arange(-1, width), up[1]])
        left, limb = np.concatenate([np.array([n], object), s, xx[up]]), 0
        while True:
            last = _reach(left) < 1 << LIMB
            part = left if last else left & ((1 << LIMB) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), v, np.int32)) for v in (width,)] + [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), limb, np.int32)), pa.array(part.astype(np.int64))], ["width", "i", "j", "limb", "part"])
            if last:
                break
            left, limb = left >> LIMB, limb + 1


@dataclass(frozen=True)
class Fit:
    """Of one length of vectors: n, S, the components as columns, their deviations and shares."""

    n: int
    sums: list[int]
    axes: np.ndarray
    sd: np.ndarray
    explained: list[float | None]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - S/n) on each component over its deviation; NaN where there is no variance."""
        top = max(map(abs, self.sums))
        if _reach(x) * self.n + top < 1 << 53:
            centred = (x * self.n - np.array(self.sums, np.int64)) / self.n
        else:
            centred = ((x.astype(object) * self.n - np.array(self.sums, object)) / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.sd > 0, centred @ self.axes / self.sd, np.nan)

    def deviation(self, x: np.ndarray) -> list[Decimal | None]:
        """The sum of (n*x - S)^2 over the dimensions."""
        reach = _reach(x) * self.n + max(map(abs, self.sums))
        kind = np.int64 if reach * reach * x.shape[1] < _LONG else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [Decimal(v) if v < 10**38 else None for v in map(int, (y * y).sum(axis=1))]


def fit(sums: pa.Table, components: int) -> dict[int, Fit]:
    """A fit for each length, from the sums of ``limbs``."""
    exact: dict[int, dict[tuple[int, int], int]] = {}
    for width, i, j, limb, part in zip(*(sums.column(c).to_pylist() for c in ("width", "i", "j", "limb", "part"))):
        cells = exact.setdefault(width, {})
        cells[i, j] = cells.get((i, j), 0) + (part << (LIMB * limb))
    found = {}
    for width, cells in exact.items():
        n, s = cells[-1, -1], [cells[-1, j] for j in range(width)]
        v = np.empty((width, width))
        for i in range(width):
            for j in range(i, width):
                v[i, j] = v[j, i] = (n * cells[i, j] - s[i] * s[j]) / (n * n)  # an exact quotient, rounded once
        trace = sum(n * cells[i, i] - s[i] * s[i] for i in range(width)) / (n * n)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        live = e > width * np.finfo(float).eps * max(e[0], 0)
        found[width] = Fit(n, s, u, np.sqrt(np.where(live, e, 0)), [float(max(x, 0) / trace) if trace else None for x in e])
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation (38 digits), whitened, explained and identity_error of each whole vector of
    ``vectors`` (vec_id, embedding) and each of the first ``components`` components."""
    rows = written(quantised(vectors, scale), "whiten-rows")
    distinct = written(rows.select("x").distinct(), "whiten-fit")
    sums = distinct.mapInArrow(limbs, "width int, i int, j int, limb int, part long")
    fits = fit(sums.groupBy("width", "i", "j", "limb").agg(F.sum("part").alias("part")).toArrow(), components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """width and w1, w2, ... of each vector."""
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                w = fits[x.shape[1]].whitened(x)
                w = np.hstack([w, np.full((len(w), components - w.shape[1]), np.nan)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), x.shape[1], np.int32)), *(pa.array(w[:, k], from_pandas=True) for k in range(components))], ["width", *names])

    names = [f"w{k}" for k in range(components)]
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    spread = distinct.mapInArrow(project, "width int, " + ", ".join(f"{c} double" for c in names))
    # covar_pop centres by running means, which it merges exactly as often as tasks are merged
    spread = spread.groupBy("width").agg(*(F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs))
    errors = {r["width"]: max((abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if r[f"c{a}_{b}"] is not None), default=None) for r in spread.collect()}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                f, w = fits[x.shape[1]], fits[x.shape[1]].whitened(x)
                ids, deviation = batch.column(0).take(pa.array(at)), pa.array(f.deviation(x), pa.decimal128(38, 0))
                for k in range(w.shape[1]):
                    same = [pa.array([v] * len(at), kind) for v, kind in ((k + 1, pa.int32()), (f.n, pa.int64()), (f.explained[k], pa.float64()), (errors[x.shape[1]], pa.float64()))]
                    yield pa.RecordBatch.from_arrays([ids, *same[:2], deviation, pa.array(w[:, k], from_pandas=True), *same[2:]], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
