"""Language-model scoring with a weighted backoff automaton.

Model. Base: add-0.1 unigrams over words and one end token per text. On top, contexts of one and of two words
(the start of a text counts as a word before its first): with c(h) the times that training texts went on after the
context h, P(w|h) = (c(hw) + mu P(w|h')) / (c(h) + mu), where h' is h without its first word. That is a backoff
model in exact form, and as an automaton: contexts that training has seen are states, and the root is the empty
one. A seen n-gram hw is an arc of state h with its own weight, to the state of the longest context that hw ends
with; for any other word a state has a failure arc of weight mu / (c(h) + mu) to the state of h', and the root has an
arc for every word. One left-to-right traversal carries the state of each text and adds up the arcs' log-weights.

Counts cover every training text. They can exceed any memory, so no task holds the model: documents are cut into
chunks, each chunk sends its distinct n-grams, dealt by hash, with its own training counts; a bucket sums them over
all chunks and answers each chunk with what the others add. The chunk's automaton has just the states and arcs that its
texts can meet. N-grams are known by hashes of a bucket's number and ``KEY_BITS`` more bits, whose chance of a collision
does not grow with the input, since a bucket gets about ``BUCKET_KEYS`` n-grams at any size.

Chunks are found again by their content, so a second reading must meet the rows in the same order and files; where a
plan does not promise that, pass ``stable=False`` and the texts are first written out. Answers lie in files of many
chunks, sorted by chunk, of which a chunk reads its own row groups.

A null text is empty: its one token is the end. A very long text is a chunk of its own and is traversed in runs, each
started two words early, which is all that a state depends on. Repeated rows count and are scored as often as they
occur; equal chunks get equal answers. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import vec
from docketry.llm.common import file_system, new_path, written

MU = (40.0, 4.0)  # weight of the shorter context's distribution, after one word and after two
CHUNK_BYTES = 8 << 20  # text bytes of a chunk
BUCKET_KEYS = 400_000  # n-grams that a bucket should get
KEY_BITS = 40
FILE_CHUNKS = 64  # chunks whose answers share a folder, where there are enough
RUN_TOKENS = 4096
ADD = 0.1

START = np.uint64(0x5851F42D4C957F2D)  # what stands before the first word of a text
END = np.uint64(0x14057B7EF767814F)  # the end token


class Chunk:
    """Token hashes of a run of texts and their distinct n-grams, in hash order; ``at[k]`` numbers them by position."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, held: np.ndarray):
        tokens, counts = [], []
        for a, b in vec.pieces(offsets, 1 << 20):
            w = vec.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            h = vec.xxh64(w.buf, w.start, w.end - w.start)
            n = np.diff(w.rows)
            out = np.full(len(h) + len(n), END, dtype=np.uint64)
            out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
            tokens.append(out)
            counts.append(n + 1)
        token, self.n = np.concatenate(tokens), np.concatenate(counts)
        self.rows = np.concatenate([[0], np.cumsum(self.n)])
        self.name = hashlib.sha1(np.ascontiguousarray(token).tobytes() + self.n.tobytes() + held.tobytes()).digest()
        first = self.rows[:-1]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first] = START
        pair = vec.mix(before, token)
        before[1:] = pair[:-1]
        triple = vec.mix(before, token)
        inner = np.ones(len(token), bool)
        inner[first] = False  # one word of context there is not more than the start
        trained = np.repeat(~held, self.n)
        self.grams, self.at, self.counts = [], [], []
        for hashes, on in ((token, None), (pair, None), (triple, inner)):
            found, at = np.unique(hashes if on is None else hashes[on], return_inverse=True)
            place = at.astype(np.int32)
            if on is not None:
                place = np.full(len(token), -1, np.int32)
                place[on] = at
            self.grams.append(found)
            self.at.append(place)
            self.counts.append(np.bincount(at[trained if on is None else trained[on]], minlength=len(found)))
        self.starts = int((~held).sum())


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, Chunk]]:
    """Batches of (doc_id, text, held_out) gathered to chunks; a chunk is at least one batch piece."""
    kept: list[pa.RecordBatch] = []
    held = 0

    def done() -> tuple[pa.Table, Chunk]:
        table = pa.Table.from_batches(kept)
        data, offsets = vec.flat(table.column(1))
        return table.select([0, 2]), Chunk(data, offsets, np.asarray(table.column(2).to_numpy(zero_copy_only=False), dtype=bool))

    for batch in batches:
        offsets = vec.flat(batch.column(1))[1]
        for a, b in vec.pieces(offsets, size):
            part = int(offsets[b] - offsets[a])
            if kept and held + part > size:
                yield done()
                kept, held = [], 0
            kept.append(batch.slice(a, b - a))
            held += part
    if kept:
        yield done()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed: small ones and small steps cost little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


class Automaton:
    """States, arcs and failure arcs that one chunk's texts can meet, as arrays.

    State 0 is the root, then come the words, the start, and the pairs. Arcs are numbered like the n-grams that they
    complete: ``source[k]``, ``target[k]`` and ``weight[k]`` of the n-grams of order k + 1, source -1 if unseen.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], starts: int, total: int, distinct: int, mu: tuple[float, float] = MU):
        uni, pair, triple = counts
        at1, at2, at3 = chunk.at
        first, words = chunk.rows[:-1], len(uni)
        start, self.pairs = words + 1, words + 2
        before = np.empty(len(at1), np.int64)  # the word's state before each position
        before[1:] = at1[:-1] + 1
        before[first] = start
        word_of, left = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        word_of[at2], left[at2] = at1, before
        inner = at3 >= 0
        context, ending = np.zeros(len(triple), np.int64), np.zeros(len(triple), np.int64)
        context[at3[inner]], ending[at3[inner]] = at2[np.flatnonzero(inner) - 1], at2[inner]
        followed = np.concatenate([[0], uni, [starts], pair]).astype(np.float64)  # an end token's are never looked at
        p1 = (uni + ADD) / (total + ADD * (distinct + 1))
        p2 = (pair + mu[0] * p1[word_of]) / (followed[left] + mu[0])
        p3 = (triple + mu[1] * p2[ending]) / (pair[context] + mu[1])
        self.weight = [np.log10(p1), np.log10(p2), np.log10(p3)]
        self.source = [np.zeros(words, np.int64), np.where(pair > 0, left, -1), np.where(triple > 0, context + self.pairs, -1)]
        self.target = [np.where(uni > 0, np.arange(words) + 1, 0), np.arange(len(pair)) + self.pairs, ending + self.pairs]
        self.back = np.concatenate([np.zeros(self.pairs, np.int64), word_of + 1])
        self.fail = np.log10(np.concatenate([[1.0], mu[0] / (followed[1 : self.pairs] + mu[0]), mu[1] / (pair + mu[1])]))
        self.start = start if starts else 0

    def traverse(self, chunk: Chunk, run: int = RUN_TOKENS) -> np.ndarray:
        """Log-probability of each text: all texts step by step together, each with its own state."""
        runs = -(-chunk.n // run)
        text = np.repeat(np.arange(len(runs)), runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        warm = np.where(number > 0, 2, 0)
        begin = chunk.rows[text] + number * run - warm
        length = np.minimum(run, chunk.n[text] - number * run) + warm
        order = np.argsort(-length, kind="stable")
        begin, length, warm = begin[order], length[order], warm[order]
        state, sums = np.where(warm > 0, 0, self.start), np.zeros(len(order))
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for step, k in enumerate(live):
            at, now = begin[:k] + step, state[:k]
            gained, then, rest = np.zeros(k), now.copy(), np.arange(k)
            for level in (2, 1, 0):
                arc = chunk.at[level][at[rest]]
                taken = np.full(len(rest), level == 0)
                if level and len(self.source[level]):
                    taken = (arc >= 0) & (self.source[level][arc] == now)
                hit = rest[taken]
                gained[hit] += self.weight[level][arc[taken]]
                then[hit] = self.target[level][arc[taken]]
                rest, now = rest[~taken], now[~taken]
                # no arc: fail, if the state is as deep as the level
                deep = now >= self.pairs if level == 2 else now > 0
                gained[rest] += np.where(deep, self.fail[now], 0.0)
                now = np.where(deep, self.back[now], now)
            sums[:k] += np.where(step >= warm[:k], gained, 0.0)
            state[:k] = then
        return np.bincount(text[order], sums, minlength=len(chunk.n))


ANSWER = "chunk binary, grams int, bucket long, added binary, n long, tokens long, distinct long, starts long"


def score(docs: DataFrame, held_out: str, mu: tuple[float, float] = MU, stable: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    ``held_out`` is an SQL condition; null counts as false.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    if not stable:
        given = written(given, "lm-texts")
    kind = given.schema["doc_id"].dataType.simpleString()
    size = given.select(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / 6 / bucket_keys)))))
    shift, key_bits = np.uint64(64 - bits), min(KEY_BITS, 64 - bits)
    chunks = -(-size // chunk_bytes)
    folders = max(1, -(-chunks // FILE_CHUNKS), min(chunks, 2 * spark.sparkContext.defaultParallelism))
    folder_of = lambda name: int.from_bytes(name[:6], "big") % folders

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches, chunk_bytes):
            for order, (keys, counts) in enumerate(zip(chunk.grams, chunk.counts, strict=True), 1):
                if not len(keys):  # texts of one token have no triples
                    continue
                bucket = (keys >> shift).astype(np.int64)
                found, first = np.unique(bucket, return_index=True)
                ends = [*first[1:], len(keys)]
                short = (keys >> np.uint64(64 - bits - key_bits)) & np.uint64((1 << key_bits) - 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "grams": pa.array(np.full(len(found), order, np.int32)),
                        "bucket": pa.array(found),
                        "chunk": pa.array([chunk.name] * len(found), pa.binary()),
                        "n": pa.array([int(b - a) for a, b in zip(first, ends, strict=True)], pa.int64()),
                        "keys": pa.array([packed(np.diff(short[a:b], prepend=np.uint64(0))) for a, b in zip(first, ends, strict=True)], pa.binary()),
                        "counts": pa.array([packed(counts[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
                        "starts": pa.array(np.where(np.arange(len(found)) == 0, chunk.starts if order == 1 else 0, 0)),
                    }
                )

    def answer(group: pa.Table) -> pa.Table:
        """What other chunks add to the counts of a bucket's n-grams, to each chunk in its own order; and the bucket's sums."""
        sizes = group.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x.as_py(), n), dtype=np.uint64) for x, n in zip(group.column("keys"), sizes, strict=True)])
        counts = np.concatenate([unpacked(x.as_py(), n) for x, n in zip(group.column("counts"), sizes, strict=True)]).astype(np.int64)
        every, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(every)).astype(np.int64)
        ends = np.cumsum(sizes)
        lead = np.arange(len(sizes)) == 0
        one = group.column("grams")[0].as_py() == 1
        return pa.table(
            {
                "chunk": group.column("chunk"),
                "grams": group.column("grams"),
                "bucket": group.column("bucket"),
                "added": pa.array([packed(total[at[e - n : e]] - counts[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()),
                "n": group.column("n"),
                "tokens": pa.array(np.where(lead & one, total.sum(), 0)),
                "distinct": pa.array(np.where(lead & one, (total > 0).sum(), 0)),
                "starts": group.column("starts"),
            }
        )

    sent = given.mapInArrow(send, "grams int, bucket long, chunk binary, n long, keys binary, counts binary, starts long")
    answers = sent.groupBy("grams", "bucket").applyInArrow(answer, ANSWER)
    path = new_path(spark, "lm-answers")
    named = answers.withColumn("folder", F.pmod(F.conv(F.hex(F.substring("chunk", 1, 6)), 16, 10).cast("long"), F.lit(folders)))
    files = named.repartition(folders, "folder").sortWithinPartitions("folder", "chunk", "grams", "bucket").write
    files.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("folder").parquet(path)
    sums = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "starts"))
    total, distinct, starts = spark.read.schema(f"{ANSWER}, folder long").parquet(path).agg(*sums).first()

    def fetch(chunk: Chunk) -> list[np.ndarray]:
        """The counts of the chunk's n-grams over all training texts."""
        fs, root = file_system(f"{path}/folder={folder_of(chunk.name)}")
        made: dict[tuple[int, int], np.ndarray] = {}  # two equal chunks get equal answers
        for file in fs.get_file_info(pafs.FileSelector(root)):
            if not file.path.endswith(".parquet"):
                continue
            with fs.open_input_file(file.path) as opened:
                table = pq.ParquetFile(opened)
                at = table.schema_arrow.get_field_index("chunk")
                for g in range(table.num_row_groups):
                    said = table.metadata.row_group(g).column(at).statistics
                    if said is not None and said.has_min_max and not said.min <= chunk.name <= said.max:
                        continue
                    group = table.read_row_group(g, columns=["chunk", "grams", "bucket", "n", "added"])
                    group = group.filter(pa.compute.equal(group["chunk"].cast(pa.binary()), pa.scalar(chunk.name, pa.binary())))
                    for grams, bucket, n, blob in zip(*(group[c].to_pylist() for c in ("grams", "bucket", "n", "added")), strict=True):
                        if (grams, bucket) not in made:
                            made[grams, bucket] = unpacked(blob, n).astype(np.int64)
        added = [[made[k] for k in sorted(made) if k[0] == order] for order in (1, 2, 3)]
        for order, (keys, more) in enumerate(zip(chunk.grams, added, strict=True), 1):
            asked, told = np.unique(keys >> shift).tolist(), sorted(bucket for grams, bucket in made if grams == order)
            if asked != told or len(keys) != sum(map(len, more)):
                raise RuntimeError(f"{len(told)} answers of {len(asked)} for a chunk: its rows came in another order than before; pass stable=False")
        return [own + np.concatenate(more) if more else own for own, more in zip(chunk.counts, added, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, chunk in _chunks(batches, chunk_bytes):
            counts = fetch(chunk)
            machine = Automaton(chunk, counts, starts, total, distinct, mu)
            columns = {
                "doc_id": table.column(0).combine_chunks(),
                "held_out": table.column(1).combine_chunks(),
                "n_tokens": pa.array(chunk.n, pa.int64()),
                "n_known": pa.array(vec.row_sums((counts[0] > 0).astype(np.int64)[chunk.at[0]], chunk.rows)),
                "train_tokens": pa.array(np.full(len(chunk.n), total), pa.int64()),
                "base_score": pa.array(vec.row_sums(machine.weight[0][chunk.at[0]], chunk.rows)),
                "score": pa.array(machine.traverse(chunk)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
