"""Quality classification by co-training.

Two classifiers see different views of a document: its text (hashed words and content statistics) and its
metadata (language, source, length). They learn from labelled documents; then, in each further round, either
view labels the documents outside that sample of which it is surest, and the other learns from these labels
too. Every such document takes part: it is scored by both views, a histogram of all margins gives the margin
that the surest ``SHARE`` of a class (by the class's share among labels; ``SHARE`` more each round) lies above,
and all documents beyond it are told, ties included. A label that is told holds for one round.

Of each class every ``FOLD``-th labelled document is kept apart: it calibrates each view (Platt scaling with
Platt's targets) and then weighs the two calibrated views. The combined model scores every document. The same
procedure learns ``quality`` and ``toxic``; a document is kept if its quality is at least 0.5 and its toxicity
below 0.5.

At most ``LABELLED`` labelled documents, those of the smallest hash of doc_id, are learned from; the others count
as unlabelled. Features of what is learned from are written to the shared folder and fitted on the executors
(``features.fit``); the driver holds weights, and the margins of the documents kept apart. Texts are read whole and
a batch at a time, so a very long one needs memory for itself only.

Nulls: a null text is empty; null metadata, or an ``n_chars`` that is no number, is a value of its own; a label
that is null is none. Labels that disagree on a doc_id count by majority, ties as 1. Documents that repeat a
doc_id are all scored; one of them is learned from. With no labelled row, or one class only, its share is every
row's score (quality 1 and toxicity 0 where there is none). An empty table gives no rows. Columns of ``docs`` may
have any names; the operator's own are added behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import vec
from docketry.llm.common import bounded_sample, written
from docketry.llm.features import STATS, Bags, Linear, Problem, bag_of, dense_of, summed, token_buckets
from docketry.llm.features import fit as descend

LABELLED = 10_000
ROUNDS = 3
PASSES, MORE_PASSES = 40, 10  # over the features, in the first and in each further round
SHARE = 0.05  # of the unlabelled rows, what a view labels more in each round
CONFIDENT = 0.97
FOLD = 4
BINS, WIDEST = 1024, 30.0  # of the margins' histogram
TARGETS = ("quality", "toxic")
VIEWS = ("text", "meta")
DECAY = {("text", "quality"): 5e-4, ("text", "toxic"): 1e-5, ("meta", "quality"): 1e-3, ("meta", "toxic"): 1e-3}
FALLBACK = {"quality": 1.0, "toxic": 0.0}
LANGS, SOURCES = 16, 64
META = LANGS + SOURCES + 3


def _hashed(column: pa.Array, buckets: int) -> np.ndarray:
    data, offsets = vec.flat(column)
    h = vec.xxh64(np.concatenate([data, np.zeros(8, np.uint8)]), offsets[:-1], np.diff(offsets), 3)
    return np.eye(buckets)[(h % np.uint64(buckets)).astype(np.int64)]


def metadata(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    length = np.nan_to_num(n_chars.to_numpy(zero_copy_only=False).astype(np.float64), nan=-1.0, posinf=-1.0, neginf=-1.0)
    scaled = np.log1p(np.maximum(length, 0))
    return np.concatenate([_hashed(lang, LANGS), _hashed(source, SOURCES), np.stack([scaled, scaled**2, length < 0], axis=1)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a small logistic regression, by Newton steps with backtracking and a slight ridge.

    ``y`` is smoothed as Platt has it, so that rows of one class, or hardly any rows, give no infinite weights.
    """
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    y = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    prior, ridge = np.append(np.full(x.shape[1], 1.0 / x.shape[1]), 0.0), np.append(np.full(x.shape[1], 1e-2), 1e-4)
    cost = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + (ridge * (w - prior) ** 2).sum() / 2
    w, now = prior.copy(), cost(prior)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * (w - prior)
        step, size = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), slope), 1.0
        while size > 1e-6 and cost(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        if size <= 1e-6:
            break
        w, before = w - size * step, now
        now = cost(w)
        if before - now < 1e-10:
            break
    return w


def _margin(logits: np.ndarray) -> np.ndarray:
    return np.clip(logits[:, 1] - logits[:, 0], -WIDEST, WIDEST)


@dataclass
class CoTrained:
    text: Linear | None
    meta: Linear | None
    platt: list[np.ndarray]
    weights: np.ndarray
    constant: float = 0.5

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        views = [w[0] * z + w[1] for w, z in zip(self.platt, (text, meta), strict=True)]
        both = np.stack(views, axis=1) @ self.weights[:2] + self.weights[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*views, both))


def inputs(docs: DataFrame) -> list[Column]:
    """text, lang and source as strings and n_chars as a double, null where ``docs`` has no such column or value."""
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return [*(text(c).alias(c) for c in ("text", "lang", "source")), text("n_chars").try_cast("double").alias("n_chars")]


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]:
    """(first row, end, tokens of the text view, metadata view) of pieces of a batch of ``inputs``."""
    data, offsets = vec.flat(batch.column("text"))
    meta = metadata(*(batch.column(c) for c in ("lang", "source", "n_chars")))
    for a, b in vec.pieces(offsets, 1 << 21):
        yield a, b, token_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), meta[a:b]


KIND = "keys binary, counts binary, stats binary, meta binary"


def features(rows: DataFrame, carried: str) -> DataFrame:
    """Both views of ``rows`` (``inputs`` and the int columns ``carried``) as ``KIND``, with these columns."""
    names = carried.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, meta in _views(batch):
                keys, counts, stats = bag_of(*tokens)
                blobs = [keys, counts, [s.tobytes() for s in stats], [m.tobytes() for m in meta]]
                own = [batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in blobs), *own], ["keys", "counts", "stats", "meta", *names])

    return rows.mapInArrow(run, ", ".join([KIND, *(f"{c} int" for c in names)]))


def once(docs: DataFrame, chosen: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of one row of each of the ``chosen`` documents (doc_id and more; bounded), with what ``chosen`` has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    return rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def all_margins(models: list[Linear], tokens: tuple[np.ndarray, np.ndarray, np.ndarray], meta: np.ndarray) -> list[np.ndarray]:
    """The margin by each of ``models`` (text and metadata view of quality, then of toxic)."""
    return [_margin(m.score_tokens(*tokens) if m.words is not None else m.logits(meta)) for m in models]


def _bin(margin: np.ndarray) -> np.ndarray:
    """The number of the bin of |margin|; -1 below ``CONFIDENT``."""
    least = np.log(CONFIDENT / (1 - CONFIDENT))
    return np.where(np.abs(margin) < least, -1, np.minimum(BINS - 1, (np.abs(margin) - least) / (WIDEST - least) * BINS)).astype(np.int64)


def told(pool: DataFrame, models: list[Linear], share: float, shares: dict[str, tuple[float, float]]) -> DataFrame:
    """Features of all rows of ``pool`` that some view is sure of, labelled for the other view.

    ``shares``: of each target, what the classes have of the labels.
    """

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(1 + len(models) * 2 * BINS)
        out[0] = batch.num_rows
        table = out[1:].reshape(len(models), 2, BINS)
        for *_, tokens, meta in _views(batch):
            for k, z in enumerate(all_margins(models, tokens, meta)):
                at = _bin(z)
                for c in (0, 1):
                    table[k, c] += np.bincount(at[(at >= 0) & ((z > 0) == c)], minlength=BINS)
        return out

    found = summed(pool, counted)
    least = np.full((len(models), 2), BINS)  # bins from here on are told
    if len(found):
        above = found[1:].reshape(len(models), 2, BINS)[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
        for k in range(len(models)):
            for c in (0, 1):
                quota = np.ceil(share * found[0] * shares[TARGETS[k // 2]][c])
                enough = np.flatnonzero(above[k, c] >= quota)
                least[k, c] = enough[-1] if len(enough) else 0
    names = [f"{v}_{t}" for t in TARGETS for v in VIEWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (ids, rows, stats), meta in _views(batch):
                labels = np.full((len(models), b - a), -1)
                for k, z in enumerate(all_margins(models, (ids, rows, stats), meta)):
                    at, c = _bin(z), (z > 0).astype(np.int64)
                    labels[k ^ 1] = np.where((at >= 0) & (at >= least[k][c]), c, -1)  # the other view of the target learns it
                on = np.flatnonzero((labels >= 0).any(axis=0))
                if len(on):
                    at = np.concatenate([[0], np.cumsum(np.diff(rows)[on])])
                    keys, counts, _ = bag_of(ids[np.arange(at[-1]) + np.repeat(rows[on] - at[:-1], np.diff(rows)[on])], at, stats)
                    blobs = [keys, counts, [stats[r].tobytes() for r in on], [meta[r].tobytes() for r in on]]
                    own = [pa.array(v[on], pa.int32(), mask=v[on] < 0) for v in labels]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in blobs), *own], ["keys", "counts", "stats", "meta", *names])

    return pool.mapInArrow(run, ", ".join([KIND, *(f"{c} int" for c in names)]))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, quality and toxic of the labelled documents to learn from, and for each whether the row is kept apart."""
    major = lambda c: (F.avg(F.col(c).cast("double")) >= 0.5).cast("int").alias(c)
    truth = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(major("quality"), major("toxic"))
    known = bounded_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(truth, "doc_id"), "doc_id", most)
    # at most ``most`` rows, so a window over a class may be one task
    apart = lambda t: ((F.row_number().over(Window.partitionBy(t).orderBy(F.xxhash64("doc_id"), "doc_id")) % FOLD == 0) & F.col(t).isNotNull()).alias(f"{t}_apart")
    return known.select("doc_id", *TARGETS, *map(apart, TARGETS))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, passes: tuple[int, int] = (PASSES, MORE_PASSES), share: float = SHARE) -> dict[str, CoTrained]:
    """Co-trained models for ``quality`` and ``toxic`` from ``labels`` (doc_id, quality, toxic)."""
    known = written(labelled_rows(docs, labels, labelled), "labelled")
    counts = known.agg(*(F.count_if(F.col(t) == c).alias(f"{t}{c}") for t in TARGETS for c in (0, 1))).first()
    shares = {t: tuple(counts[f"{t}{c}"] / max(counts[f"{t}0"] + counts[f"{t}1"], 1) for c in (0, 1)) for t in TARGETS}
    made = {t: CoTrained(None, None, [], np.zeros(0), shares[t][1] if sum(shares[t]) else FALLBACK[t]) for t in TARGETS}
    if not any(min(shares[t]) > 0 for t in TARGETS):
        return made
    learned = [F.when(~F.col(f"{t}_apart"), F.col(t)).alias(f"{v}_{t}") for t in TARGETS for v in VIEWS]
    checked = [F.when(F.col(f"{t}_apart"), F.col(t)).alias(f"check_{t}") for t in TARGETS]
    names = [f"{v}_{t}" for t in TARGETS for v in VIEWS]
    base = written(features(once(docs, known, *inputs(docs)).select("text", "lang", "source", "n_chars", *learned, *checked), " ".join([*names, *(f"check_{t}" for t in TARGETS)])), "features")
    problems = [Problem(f"{v}_{t}", 2, *(("stats", STATS, True) if v == "text" else ("meta", META, False)), DECAY[v, t]) for t in TARGETS for v in VIEWS]
    models = [Linear(2, p.width, p.words) for p in problems]
    models = descend(base.select("keys", "counts", "stats", "meta", *names), problems, models, passes[0])
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *inputs(docs)).join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").drop("doc_id")
    for k in range(1, rounds):
        more = written(told(pool, models, k * share, shares), "told")
        models = descend(base.select("keys", "counts", "stats", "meta", *names).unionByName(more), problems, models, passes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = Bags(batch.column("keys"), batch.column("counts"))
            z = [_margin(m.logits(dense_of(batch, p.dense), bags)) for m, p in zip(models, problems, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, z), *(batch.column(f"check_{t}") for t in TARGETS)], [*names, *(f"check_{t}" for t in TARGETS)])

    apart = base.where(" or ".join(f"check_{t} is not null" for t in TARGETS))
    seen = apart.mapInArrow(run, ", ".join([*(f"{c} double" for c in names), *(f"check_{t} int" for t in TARGETS)])).toArrow()  # numbers of at most LABELLED / FOLD rows a target
    for j, t in enumerate(TARGETS):
        if min(shares[t]) > 0:
            rows = seen.filter(pa.compute.is_valid(seen[f"check_{t}"]))
            y = rows[f"check_{t}"].to_numpy()
            margins = [rows[f"{v}_{t}"].to_numpy() for v in VIEWS]
            platt = [logistic(m[:, None], y) for m in margins]
            calibrated = np.stack([w[0] * m + w[1] for w, m in zip(platt, margins, strict=True)], axis=1)
            made[t] = CoTrained(models[2 * j], models[2 * j + 1], platt, logistic(calibrated, y), shares[t][1])
    return made


SCORES = "text_score double, meta_score double, quality double, toxicity double, kept boolean"


def score(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """``docs`` as a struct column ``row`` with text_score, meta_score, quality, toxicity and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for a, b, tokens, meta in _views(batch):
                for name, at in (("quality", (0, 1, 2)), ("toxic", (None, None, 3))):
                    m = models[name]
                    views = (np.full(b - a, m.constant),) * 3 if m.text is None else m.combine(*all_margins([m.text, m.meta], tokens, meta))
                    for k, p in zip(at, views, strict=True):
                        if k is not None:
                            out[k, a:b] = p
            kept = (out[2] >= 0.5) & (out[3] < 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, out), pa.array(kept)], ["row", "text_score", "meta_score", "quality", "toxicity", "kept"])

    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *inputs(docs))
    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, {SCORES}")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text", "lang", "source", "n_chars"), fit(docs, labels)).select("row.doc_id", "text_score", "meta_score", "quality", "toxicity", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    return score(docs, fit(docs, labels)).where("kept").select("row.*")
