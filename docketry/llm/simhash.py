"""SimHash near-dedup over vantage-point trees.

``fingerprints`` reduces each text to one or more 64-bit majority fingerprints of its word windows.
``near_groups`` links fingerprints that differ in few bits and returns connected groups.

Search. A pair within the radius in all bits is within a smaller radius in one of several views (parts
of the fingerprint; their radii + 1 sum to more than the radius, by the pigeonhole rule). Each view has a
vantage-point tree: a node splits its fingerprints by Hamming distance to a vantage point at ``mu``. By
the triangle inequality two points of which one is outside (distance > mu) and one inside meet inside if
the outer one is no further than ``mu + radius``; so points of that ring go both ways, and every pair
within the radius shares at least one leaf. The top of the tree is built from a bounded sample and deals
the fingerprints to shards; each shard builds the rest of its tree from its own rows and compares within
small leaves. Exact copies are one node, and a shard returns a forest, never all pairs of a group.

Nulls: a null text has no words; without words the fingerprint is zero, and zeros link like others. A
row with null ``doc_id`` links nothing; it gets the group of its fingerprint where another row has it,
else null. Other columns of the input are ignored, whatever their names. Texts are read whole and hashed some at a
time; a very long one needs memory for itself only.

The pipeline's stage decides by similarity: fingerprints only find candidates, and a link needs a Jaccard
similarity of the distinct shingles of ``SIMILAR`` and more. The sets lie in files in the shared folder, where
a shard reads those of its candidates; a row's node number says where its set is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import vec
from docketry.llm.common import bounded_sample, file_system, new_path, written
from docketry.llm.components import components

SAMPLE_ROWS = 30_000  # fingerprints from which the tops of the trees are built
SHARD_ROWS = 12_000  # rows a shard should have
LEAF_ROWS = 256  # below this a leaf is compared row by row
WIDE_SHARD_ROWS = 48_000  # the same for the stage, which has more views
SIMILAR = (4, 5)  # least share of common shingles of a link in the stage
PLACE_BITS = 33  # of a node number: the place in its file, in words of 8 bytes (64 GB); the 30 bits above number the file
CACHED = 1 << 23  # shingles and verdicts that a shard holds at most before it reads or compares again


@dataclass(frozen=True)
class View:
    """``bits`` bits of a fingerprint of 64-bit words: part ``half`` (0 lowest) of word ``word``."""

    word: int
    half: int
    radius: int
    bits: int = 32


@dataclass(frozen=True)
class Scheme:
    shingle: int
    words: int  # 64-bit words a fingerprint has
    radius: int  # most differing bits of a link, over all words
    views: tuple[View, ...]


#: Exact: at most 4 of 64 bits means at most 2 in the high half or at most 1 in the low half.
EXACT_64 = Scheme(4, 1, 4, (View(0, 1, 2), View(0, 0, 1)))
#: Candidates for five-word shingles of Jaccard similarity 0.8 and more: about 78 of 512 bits differ at 0.8, with a
#: deviation of 8, and at most 96 in texts of a few shingles; unrelated texts differ in 256 +- 11. A pair at 0.8
#: shares one of 32 views within 1 bit with a chance of 0.999.
WIDE_512 = Scheme(5, 8, 140, tuple(View(w, k, 1, 16) for w in range(8) for k in range(4)))


def fingerprints(docs: DataFrame, scheme: Scheme, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` (binary, little-endian words) of each row. A window's hash is its XXH64, seed 42."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.flat(batch.column(len(keys)))
            out = np.zeros((batch.num_rows, scheme.words), dtype="<u8")
            for a, b in vec.pieces(offsets, 1 << 20):
                words = vec.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                start, size, rows = words.windows(scheme.shingle)
                h = vec.xxh64(words.buf, start, size)
                for w in range(scheme.words):
                    out[a:b, w] = vec.majority(vec.mix(h, np.uint64(w)) if w else h, rows)
            fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * scheme.words), batch.num_rows, [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp.cast(pa.binary())], [*keys, "fp"])

    given = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{kinds}, fp binary")


def shingle_sets(docs: DataFrame, scheme: Scheme, folder: str) -> DataFrame:
    """doc_id, the text's ``mark``, ``key`` (equal for equal sets), ``fp`` of the distinct shingles, and ``node``, the place of the set in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(folder)
        files.create_dir(top, recursive=True)
        number, at = TaskContext.get().taskAttemptId(), 0
        if number >> (63 - PLACE_BITS):
            raise OverflowError("more tasks in this application than node numbers have room for")
        with files.open_output_stream(f"{top}/{number}") as out:
            for batch in batches:
                data, offsets = vec.flat(batch.column(2))
                fp = np.zeros((batch.num_rows, scheme.words), dtype="<u8")
                key = np.zeros((batch.num_rows, 2), dtype="<u8")
                node = np.zeros(batch.num_rows, dtype=np.int64)
                for a, b in vec.pieces(offsets, 1 << 20):
                    words = vec.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    start, size, rows = words.windows(scheme.shingle)
                    h, rows = distinct(vec.xxh64(words.buf, start, size), rows)
                    for w in range(scheme.words):
                        fp[a:b, w] = vec.majority(vec.mix(h, np.uint64(w)) if w else h, rows)
                    for k in range(2):
                        key[a:b, k] = vec.row_sums(vec.mix(h, np.uint64(1001 + k)), rows)
                    node[a:b] = at + rows[:-1] + np.arange(b - a)
                    stored = np.insert(h, rows[:-1], np.diff(rows).astype(np.uint64)).astype("<u8")
                    out.write(stored.tobytes())
                    at += len(stored)
                    if at >> PLACE_BITS:
                        raise OverflowError("more shingles in a task than node numbers have room for")
                node += number << PLACE_BITS
                fixed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), batch.num_rows, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (key, fp)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *fixed, pa.array(node)], ["doc_id", "mark", "key", "fp", "node"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, mark long, key binary, fp binary, node long")


def text_mark() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and their row offsets."""
    own = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(rows) - 1))]).astype(np.int64)


class Sets:
    """Exact similarity of nodes by their sets in ``folder``."""

    def __init__(self, folder: str):
        self.files, self.top = file_system(folder)
        self.open, self.sets, self.held, self.known = {}, {}, 0, {}

    def of(self, node: int) -> np.ndarray:
        found = self.sets.get(node)
        if found is None:
            number, place = node >> PLACE_BITS, 8 * (node & (1 << PLACE_BITS) - 1)
            if number not in self.open:
                if len(self.open) >= 256:
                    self.open.pop(next(iter(self.open))).close()
                self.open[number] = self.files.open_input_file(f"{self.top}/{number}")
            raw = self.open[number].read_at(4096, place)
            size = 8 + 8 * int.from_bytes(raw[:8], "little")
            if size > len(raw):
                raw += self.open[number].read_at(size - len(raw), place + len(raw))
            found = np.frombuffer(raw[8:size], dtype="<u8")
            self.held += len(found)
            if self.held > CACHED:
                self.sets, self.held = {}, len(found)
            self.sets[node] = found
        return found

    def alike(self, node: int, others: np.ndarray) -> np.ndarray:
        """Whether each of ``others`` has at least the share ``SIMILAR`` of shingles in common with ``node``."""
        a, answers, (least, of) = self.of(node), [], SIMILAR
        for other in others.tolist():
            pair = (node, other) if node < other else (other, node)
            said = self.known.get(pair)
            if said is None:
                b = self.of(other)
                said = False
                if of * min(len(a), len(b)) >= least * max(len(a), len(b)):
                    small, large = (a, b) if len(a) < len(b) else (b, a)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    said = (least + of) * both >= least * (len(a) + len(b))
                if len(self.known) >= CACHED // 8:
                    self.known = {}
                self.known[pair] = said
            answers.append(said)
        return np.array(answers, dtype=bool)


def _far(points: np.ndarray, view: View) -> np.ndarray:
    """The view's bits of each fingerprint."""
    return (points[:, view.word] >> np.uint64(view.bits * view.half) & np.uint64((1 << view.bits) - 1)).astype(np.uint32)


def _distance(bits: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(bits ^ to).astype(np.int16)


def _split(bits: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint32, int] | None:
    """A vantage point and the distance that parts ``bits`` best, or None where no cut makes both sides smaller."""
    best, few = None, len(bits)
    probe = bits if len(bits) <= 2048 else bits[rng.integers(0, len(bits), 2048)]
    for at in rng.integers(0, len(bits), 4):
        counts = np.bincount(_distance(probe, bits[at]), minlength=33)
        upto = np.cumsum(counts)
        inner = upto[np.minimum(np.arange(33) + radius, 32)]
        larger = np.maximum(inner, upto[-1] - upto)
        mu = int(np.argmin(larger))
        if larger[mu] * len(bits) < few * len(probe):
            best, few = (bits[at], mu), larger[mu] * len(bits) / len(probe)
    return best if few < 0.95 * len(bits) else None


class Tree:
    """The top of a vantage-point tree: ``nodes`` are (vantage, mu, inner, outer); a negative child is leaf ``-1-child``."""

    def __init__(self, bits: np.ndarray, radius: int, most: float, least_leaves: int):
        self.radius, self.nodes, self.leaves = radius, [], 0
        rng = np.random.default_rng(7)
        most = min(most, len(bits) / least_leaves)

        def grow(part: np.ndarray) -> int:
            cut = _split(part, radius, rng) if len(part) > max(most, 8) else None
            if cut is None:
                self.leaves += 1
                return -self.leaves
            at = len(self.nodes)
            self.nodes.append(None)
            d = _distance(part, cut[0])
            self.nodes[at] = (*cut, grow(part[d <= cut[1] + radius]), grow(part[d > cut[1]]))
            return at

        self.root = grow(bits)

    def deal(self, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, row numbers) for each leaf that rows reach."""
        open_ = [(self.root, np.arange(len(bits)))]
        while open_:
            at, rows = open_.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -1 - at, rows
                continue
            vantage, mu, inner, outer = self.nodes[at]
            d = _distance(bits[rows], vantage)
            open_ += [(inner, rows[d <= mu + self.radius]), (outer, rows[d > mu])]


Alike = Callable[[int, np.ndarray], np.ndarray]


def _leaf_links(points: np.ndarray, bits: np.ndarray, rows: np.ndarray, scheme: Scheme, near: int, alike: Alike | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked row numbers of one leaf. A large leaf that no vantage point parts is walked group by group:
    rows once reached are taken out of the search, so a dense group costs its size, not its square. So are
    the candidates of any leaf if ``alike`` is to confirm each link."""
    rest = rows
    if len(rows) <= 4 * LEAF_ROWS:
        own = bits[rows]
        a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= near, 1))
        a, b = rows[a], rows[b]
        ok = np.bitwise_count(points[a] ^ points[b]).sum(axis=1, dtype=np.int32) <= scheme.radius
        if alike is None:
            yield a[ok], b[ok]
            return
        rest = np.unique(np.concatenate([a[ok], b[ok]]))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = np.bitwise_count(points[rest] ^ points[at]).sum(axis=1, dtype=np.int32) <= scheme.radius
            if alike is not None and hit.any():
                hit[hit] = alike(at, rest[hit])
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                front += found.tolist()
                yield np.full(len(found), at), found


def shard_links(points: np.ndarray, scheme: Scheme, view: View, alike: Alike | None = None) -> np.ndarray:
    """For each point of a shard the smallest row number of its group: links by the shard's own subtree."""
    rng, bits, label = np.random.default_rng(11), _far(points, view), np.arange(len(points))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    open_ = [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        cut = _split(bits[rows], view.radius, rng) if len(rows) > LEAF_ROWS else None
        if cut is None:
            pairs += _leaf_links(points, bits, rows, scheme, view.radius, alike)
            continue
        d = _distance(bits[rows], cut[0])
        open_ += [rows[d <= cut[1] + view.radius], rows[d > cut[1]]]
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        label = roots(len(points), a, b)
    return label


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of ``n`` nodes, in memory."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _points(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u8").reshape(-1, words) if len(column) else np.zeros((0, words), "<u8")


def links(classes: DataFrame, scheme: Scheme, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, sets: str | None = None) -> DataFrame:
    """(a, b) links between rows of ``classes`` (node long, fp binary): a forest of the links in each shard.

    With ``sets``, the folder of ``shingle_sets``, links within the radius count only if the sets are alike.
    """
    total = classes.count()
    sample = _points(bounded_sample(classes, "node", sample_rows).select("fp").toArrow().column(0), scheme.words)
    trees = [Tree(_far(sample, v), v.radius, shard_rows * len(sample) / max(total, 1), 48 // len(scheme.views) + 8) for v in scheme.views] if len(sample) else []
    first = np.cumsum([0, *(t.leaves for t in trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column(1), scheme.words)
            for k, tree in enumerate(trees):
                for leaf, rows in tree.deal(_far(points, scheme.views[k])):
                    own = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), first[k] + leaf, dtype=np.int32)), *own.columns], ["shard", "node", "fp"])

    def compare(group: pa.Table) -> pa.Table:
        view = scheme.views[int(np.searchsorted(first, group.column(0)[0].as_py(), side="right")) - 1]
        nodes = group.column(1).to_numpy()
        alike = None
        if sets is not None:
            known = Sets(sets)
            alike = lambda row, rows: known.alike(int(nodes[row]), nodes[rows])
        label = shard_links(_points(group.column(2), scheme.words), scheme, view, alike)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": nodes[tied], "b": nodes[label[tied]]})

    return classes.select("node", "fp").mapInArrow(deal, "shard int, node long, fp binary").groupBy("shard").applyInArrow(compare, "a long, b long")


def near_groups(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """``fps`` (doc_id, fp) with ``component_id``: the smallest doc_id reachable over links within the radius."""
    classes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = components(links(classes, scheme))
    groups = classes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, scheme: Scheme = EXACT_64) -> DataFrame:
    """doc_id, fp and component_id of all rows of ``docs`` (doc_id, text)."""
    return near_groups(written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scheme), "fingerprints"), scheme)


def drop_near_copies(docs: DataFrame, scheme: Scheme = WIDE_512) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; all columns of ``docs`` as they are.

    Rows are near copies if at least 0.8 of their distinct shingles are common, and so are those that a chain of
    near copies ties. A doc_id may stand for several texts: each is judged by itself. Rows without doc_id are kept.
    """
    folder = new_path(docs.sparkSession, "shingles")
    prints = written(shingle_sets(docs, scheme, folder), "fingerprints")
    named_sets = prints.where("doc_id is not null").groupBy("key")
    classes = written(named_sets.agg(F.min("node").alias("node"), F.min("fp").alias("fp"), F.min(F.struct("doc_id", "mark")).alias("lead")), "classes")
    found = components(links(classes, scheme, shard_rows=WIDE_SHARD_ROWS, sets=folder))
    leaders = classes.join(found, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("lead").alias("lead")).select(F.col("lead.doc_id").alias("_doc"), F.col("lead.mark").alias("_mark"))
    width = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_mark().alias("_mark"), width.alias("_row"))
    kept = named.join(leaders, ["_doc", "_mark"], "left_semi")
    once = kept.dropDuplicates(["_doc", "_mark"])
    return once.unionByName(named.where("_doc is null")).select("_row.*")
