"""Media columns: TIFF files in a binary column, one row per page.

``pages`` walks the image directories of each file (both byte orders, classic and 64-bit offsets), decodes the strips or
tiles (stored, PackBits, LZW, deflate), undoes the horizontal predictor and returns the samples of each page, row by
row, channels side by side, little-endian; samples of fewer than 8 bits get a byte each. ``media`` is the way in: bytes
become pages of 64 columns of 8-bit samples.

A null or broken file gives one row with ``error`` and no samples, a broken page a row of its own with ``error``; the
pages before and after it stay. A chain of directories that runs in a circle ends with an error. A page of more than
``MOST_BYTES`` decoded bytes is an error, not cut. Files are taken whole, and a page's samples are held one page at a
time. Empty tables give no rows; repeated rows are read each on their own. The key columns keep their names and values;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import vec

WIDTH = 64  # columns of a page that media() makes
PAGE_ROWS = 256
MOST_BYTES = 1 << 30
PIECE = 1 << 22  # bytes that are stored or handed on at once

# Fixed values of the format: tags, field types of whole numbers, compressions.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 266: "fill_order", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_sizes", 339: "sample_format"}
TYPES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

_WIDTHS = np.repeat(np.array([9, 10, 11, 12]), [254, 512, 1024, 2307])  # bits of the n-th code after a clear code


class Broken(ValueError):
    """What is wrong with a file or a page."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    photometric: int
    sample_format: int
    samples: bytes


def unpack_bits(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += head + 2
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


def pack_bits(data: np.ndarray) -> bytes:
    """Each row of ``data`` on its own: runs of three and more, literals between them, at most 128 bytes each."""
    height, width = data.shape
    flat = data.ravel()
    edge = np.ones(len(flat) + 1, dtype=bool)
    edge[1:-1] = flat[1:] != flat[:-1]
    edge[np.arange(0, len(flat), width)] = True
    start = np.flatnonzero(edge)
    size = np.diff(start)
    start, run = start[:-1], size >= 3
    # shorter runs next to each other in one row are one literal
    join = np.zeros(len(run), dtype=bool)
    join[1:] = ~run[1:] & ~run[:-1] & (start[1:] % width != 0)
    head = np.flatnonzero(~join)
    size, start, run = np.add.reduceat(size, head), start[head], run[head]
    parts = (size + 127) // 128
    which = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start, size, run = start[which] + 128 * nth, np.minimum(size[which] - 128 * nth, 128), run[which]
    run &= size > 1
    takes = np.where(run, 2, size + 1)
    at = np.cumsum(takes) - takes
    out = np.empty(int(takes.sum()), np.uint8)
    out[at] = np.where(run, 257 - size, size - 1)
    out[at[run] + 1] = flat[start[run]]
    plain = np.flatnonzero(~run)
    inner = np.arange(int(size[plain].sum())) - np.repeat(np.cumsum(size[plain]) - size[plain], size[plain])
    out[np.repeat(at[plain] + 1, size[plain]) + inner] = flat[np.repeat(start[plain], size[plain]) + inner]
    return out.tobytes()


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, a bit wider one code early. Codes are cut out together up to a clear code."""
    buf = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    total, at, out, singles = 8 * len(data), 0, [], [bytes([k]) for k in range(256)] + [b"", b""]
    while at + 9 <= total:
        widths = _WIDTHS
        table, before = list(singles), b""
        add, emit = table.append, out.append
        while True:
            ends = at + np.cumsum(widths)
            ends = ends[ends <= total]
            if not len(ends):
                return b"".join(out)
            w = widths[: len(ends)]
            first = ends - w
            byte = first >> 3
            codes = (buf[byte] << 16) | (buf[byte + 1] << 8) | buf[byte + 2]
            codes = (codes >> (24 - (first & 7) - w).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == CLEAR) | (codes == END))
            last = int(stop[0]) if len(stop) else len(codes)
            for code in codes[:last].tolist():
                if code < len(table):
                    now = table[code]
                elif before and code == len(table):
                    now = before + before[:1]
                else:
                    raise Broken("a code of no table entry")
                if before and len(table) < 4096:
                    add(before + now[:1])
                emit(now)
                before = now
            if len(stop):
                at = int(ends[last])
                if codes[last] == END:
                    return b"".join(out)
                break
            at = int(ends[-1])
            widths = np.full(4096, 12)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [CLEAR], [np.array([9])]
    table: dict[int, int] = {}
    code, emitted, free = -1, 0, 258
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        known = table.get(key)
        if known is not None:
            code = known
            continue
        codes.append(code)
        emitted += 1
        table[key] = free
        free += 1
        code = b
        if free == 4094:
            codes.append(CLEAR)
            widths.append(_WIDTHS[: emitted + 1])
            table, emitted, free = {}, 0, 258
    if code >= 0:
        codes.append(code)
        emitted += 1
    codes.append(END)
    widths.append(_WIDTHS[: emitted + 1])
    c, w = np.array(codes, np.uint32), np.concatenate(widths)
    bits = ((c[:, None] >> np.arange(11, -1, -1, dtype=np.uint32)) & 1).astype(bool)
    return np.packbits(bits[np.arange(12) >= 12 - w[:, None]]).tobytes()


def _decoded(data: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data)
    elif compression == LZW:
        out = lzw_decode(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise Broken(f"compression {compression}")
    if len(out) < size:
        raise Broken(f"{len(out)} of {size} bytes of a strip or tile")
    return out[:size]


def _block(data: bytes, order: str, d: dict, rows: int, columns: int, channels: int) -> np.ndarray:
    """rows x columns x channels samples of a strip or tile."""
    bits, kind = d["bits"][0], d["sample_format"][0]
    line = (columns * channels * bits + 7) // 8
    raw = _decoded(data, d["compression"][0], rows * line)
    if d["fill_order"][0] == 2:
        raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
    if bits < 8:
        each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : columns * channels * bits]
        found = (each.reshape(rows, columns, channels, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    else:
        name = {1: "u", 2: "i", 3: "f", 4: "u"}.get(kind, "u")
        if f"{name}{bits // 8}" not in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f2", "f4", "f8") or bits % 8:
            raise Broken(f"samples of {bits} bits, format {kind}")
        found = np.frombuffer(raw, f"{order}{name}{bits // 8}").reshape(rows, columns, channels)
    if d["predictor"][0] == 2:
        whole = found.view(found.dtype.str.replace("f", "u").replace("i", "u"))
        found = np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("=")).astype(whole.dtype).view(found.dtype)
        if bits < 8:
            found = found & ((1 << bits) - 1)
    elif d["predictor"][0] != 1:
        raise Broken(f"predictor {d['predictor'][0]}")
    return found


def _page(data: bytes, order: str, d: dict, number: int) -> Page:
    tiled = "tile_offsets" in d
    for name in ("width", "height", *(("tile_width", "tile_height") if tiled else ())):
        if name not in d:
            raise Broken(f"no {name}")
    d = {"bits": (1,), "compression": (1,), "photometric": (0,), "fill_order": (1,), "samples": (1,), "planar": (1,), "predictor": (1,), "sample_format": (1,)} | d
    width, height, channels, planar = d["width"][0], d["height"][0], d["samples"][0], d["planar"][0] == 2
    if len(set(d["bits"])) > 1:
        raise Broken(f"channels of {d['bits']} bits")
    offsets, sizes = (d.get(f"{'tile' if tiled else 'strip'}_{x}") for x in ("offsets", "sizes"))
    if not offsets or not sizes:
        raise Broken("no strips or tiles")
    across, down = (d["tile_width"][0], d["tile_height"][0]) if tiled else (width, min(d.get("rows_per_strip", (height,))[0], height))
    if min(width, height, channels, across, down, d["bits"][0]) < 1:
        raise Broken("a size of zero")
    if max(width * height, across * down) * channels * max(1, d["bits"][0] // 8) > MOST_BYTES:
        raise Broken("a page of more bytes than allowed")
    grid = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
    planes, each = (channels, 1) if planar else (1, channels)
    if min(len(offsets), len(sizes)) < len(grid) * planes:
        raise Broken("too few strips or tiles")
    whole = None
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        if k >= len(grid) * planes:
            break
        plane, (y, x) = k // len(grid), grid[k % len(grid)]
        rows = down if tiled else min(down, height - y)
        if at + size > len(data):
            raise Broken("a strip or tile beyond the end")
        block = _block(data[at : at + size], order, d, rows, across, each)
        if whole is None:
            whole = np.empty((height, width, channels), block.dtype.newbyteorder("<"))
        whole[y : y + down, x : x + across, plane : plane + each] = block[: height - y, : width - x]
    return Page(number, width, height, channels, d["bits"][0], d["compression"][0], d["photometric"][0], d["sample_format"][0], whole.tobytes())


def directories(data: bytes) -> Iterator[tuple[str, dict]]:
    """The byte order and fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise Broken("no such file")
    big = struct.unpack_from(f"{order}H", data, 2)[0]
    if big not in (42, 43):
        raise Broken("no such file")
    word, count, entry = ("Q", "Q", 20) if big == 43 else ("I", "H", 12)
    seen: set[int] = set()
    at = struct.unpack_from(f"{order}{word}", data, 8 if big == 43 else 4)[0]
    while at:
        if at in seen:
            raise Broken("directories in a circle")
        seen.add(at)
        n = struct.unpack_from(f"{order}{count}", data, at)[0]
        first, room = at + struct.calcsize(f"={count}"), struct.calcsize(f"={word}")
        if first + n * entry + room > len(data):
            raise Broken("a directory beyond the end")
        fields = {}
        for e in range(first, first + n * entry, entry):
            tag, kind = struct.unpack_from(f"{order}HH", data, e)
            values = struct.unpack_from(f"{order}{word}", data, e + 4)[0]
            if tag not in TAGS or kind not in TYPES or not values:
                continue
            size, place = values * struct.calcsize(f"={TYPES[kind]}"), e + 4 + room
            if size > room:
                place = struct.unpack_from(f"{order}{word}", data, place)[0]
            if place + size > len(data):
                raise Broken("a field beyond the end")
            fields[TAGS[tag]] = struct.unpack_from(f"{order}{values}{TYPES[kind]}", data, place)
        yield order, fields
        at = struct.unpack_from(f"{order}{word}", data, first + n * entry)[0]


def read(data: bytes | None) -> Iterator[Page | str]:
    """Each page, or what is wrong with it."""
    if data is None:
        yield "no file"
        return
    number = 0
    try:
        for order, fields in directories(data):
            try:
                yield _page(data, order, fields, number)
            except (Broken, zlib.error, struct.error, OverflowError) as fault:
                yield f"{fault}"
            number += 1
    except (Broken, struct.error, OverflowError) as fault:
        yield f"{fault}"


def write(images: list[tuple[np.ndarray, int, int, int]]) -> bytes:
    """A little-endian file of pages (rows x columns samples of 8 bits, compression, predictor, edge of a tile or 0 for strips)."""
    out, after = bytearray(b"II*\0\0\0\0\0"), 4
    for samples, compression, predictor, tile in images:
        height, width = samples.shape
        lines = tile or 64
        blocks = []
        for y in range(0, height, lines):
            for x in range(0, width, tile or width):
                block = samples[y : y + lines, x : x + (tile or width)]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.hstack([block[:, :1], np.diff(block, axis=1)])
                if compression == PACKBITS:
                    made = pack_bits(np.ascontiguousarray(block))
                else:
                    made = {STORED: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[compression](block.tobytes())
                blocks.append((len(out), len(made)))
                out += made + b"\0" * (len(made) % 2)
        fields = {256: [width], 257: [height], 258: [8], 259: [compression], 262: [1], 277: [1], 317: [predictor]}
        at, sizes = ([b[k] for b in blocks] for k in (0, 1))
        fields |= {322: [tile], 323: [tile], 324: at, 325: sizes} if tile else {273: at, 278: [lines], 279: sizes}
        placed = {}
        for tag, values in fields.items():
            if len(values) > 1:
                placed[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, after, len(out))
        out += struct.pack("<H", len(fields))
        for tag, values in sorted(fields.items()):
            out += struct.pack("<HHII", tag, 4, len(values), placed.get(tag, values[0]))
        after = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: How the pages of one payload are stored in turn: compression, predictor, edge of a tile (0: strips).
CODINGS = ((DEFLATE, 2, 0), (PACKBITS, 1, WIDTH), (LZW, 1, 0))


def store(payload: bytes) -> bytes:
    """A file of pages of 64 columns; zero bytes fill up the last row, and an empty payload is one row."""
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % WIDTH or (0 if payload else WIDTH)), np.uint8).reshape(-1, WIDTH)
    return write([(samples[y : y + PAGE_ROWS], *CODINGS[(len(samples) + k) % len(CODINGS)]) for k, y in enumerate(range(0, len(samples), PAGE_ROWS))])


def media(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``n_bytes`` of the text in UTF-8 (null: empty) and ``media``, the file that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vec.flat(batch.column(len(keys)))
            for a, b in vec.pieces(offsets, PIECE):
                files = [store(data[x:y].tobytes()) for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                own = batch.slice(a, b - a).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets[a : b + 1])), pa.array(files, pa.binary())], [*keys, "n_bytes", "media"])

    given = docs.select(*keys, F.col("text").cast("string").alias("_text"))
    return given.mapInArrow(run, f"{_kinds(given, keys)}, n_bytes long, media binary")


def _kinds(df: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


_FIELDS = ("width", "height", "channels", "bits", "compression", "photometric", "sample_format")


def pages(files: DataFrame, keys: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """A row for each page of the files of ``column``: ``keys``, ``media_bytes`` and ``media_sha256`` of the file, ``page``
    (from 0), its sizes and kinds, ``samples`` and ``error``. A file's pages follow each other in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int32()] * len(_FIELDS), pa.binary(), pa.string()]
        names = [*keys, "media_bytes", "media_sha256", "page", *_FIELDS, "samples", "error"]

        def batched(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            own = [c.take(pa.array(at)) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

        for batch in batches:
            at, rows, held = [], [], 0
            for i, cell in enumerate(batch.column(len(keys))):
                file = cell.as_py()
                own = (len(file), hashlib.sha256(file).hexdigest()) if file is not None else (None, None)
                for number, page in enumerate(read(file)):
                    if isinstance(page, Page):
                        rows.append((*own, number, *(getattr(page, f) for f in _FIELDS), page.samples, None))
                        held += len(page.samples)
                    else:
                        rows.append((*own, number, *[None] * len(_FIELDS), None, page))
                    at.append(i)
                    if held >= PIECE or len(rows) >= 4096:
                        yield batched(batch, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield batched(batch, at, rows)

    given = files.select(*keys, column)
    sizes = ", ".join(f"{f} int" for f in _FIELDS)
    return given.mapInArrow(run, f"{_kinds(given, keys)}, media_bytes long, media_sha256 string, page int, {sizes}, samples binary, error string")


def average_hash(image: np.ndarray) -> int:
    """64 bits: whether the samples of each of 8 x 8 cells are brighter than the page's, on average."""
    image = image.astype(np.int64)
    cuts = [np.arange(8) * n // 8 for n in image.shape]
    cells = np.add.reduceat(np.add.reduceat(image, cuts[0], axis=0), cuts[1], axis=1)
    count = np.outer(*(np.maximum(np.diff(np.append(c, n)), 1) for c, n in zip(cuts, image.shape)))
    bright = cells * image.size > int(image.sum()) * count
    return int.from_bytes(np.packbits(bright).tobytes(), "big")


class _File:
    """What the pages of one file come to, in their order."""

    def __init__(self, key: tuple, own: tuple):
        self.key, self.own, self.digest, self.bytes, self.total, self.tail, self.pages, self.hash, self.fault = key, own, hashlib.sha256(), 0, 0, b"", 0, 0, None

    def add(self, height: int | None, samples: bytes | None, error: str | None) -> None:
        if error is not None:
            self.fault = self.fault or error
            return
        self.digest.update(samples)
        flat = np.frombuffer(samples, np.uint8)
        self.bytes += len(samples)
        self.total += int(flat.sum(dtype=np.int64))
        self.tail = (self.tail + samples[-64:])[-64:]
        self.hash = self.hash if self.pages else average_hash(flat.reshape(height, -1))
        self.pages += 1

    def row(self) -> tuple:
        if self.fault:
            return (*self.key, None, None, None, *self.own, f"broken: {self.fault}")
        mean = 1000 * self.total // max(1, self.bytes)
        return (*self.key, self.bytes, self.digest.hexdigest(), zlib.crc32(self.tail), *self.own, f"{self.pages} pages, mean {mean} thousandths, hash {self.hash:016x}")


def features(files: DataFrame, keys: tuple[str, ...] = ("doc_id", "n_bytes"), column: str = "media") -> DataFrame:
    """``keys`` and what the pages of each file come to: payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes),
    media_bytes, media_sha256 and feature: the number of pages, the mean sample and the first page's average hash. A
    file with a fault has a feature that names it, and nulls for what would come from its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batched(done: list[_File]) -> pa.RecordBatch:
            rows = [f.row() for f in done]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        names = [*keys, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds, done, now = [], [], None
        for batch in batches:
            kinds = [*(c.type for c in batch.columns[: len(keys)]), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cells = [batch.column(k) for k in range(len(keys))] + [batch.column(c) for c in ("media_bytes", "media_sha256", "page", "height", "samples", "error")]
            for *own, size, digest, page, height, samples, error in zip(*(c.to_pylist() for c in cells)):
                if page == 0:
                    done += [now] if now else []
                    now = _File(tuple(own), (size, digest))
                now.add(height, samples, error)
            if len(done) >= 4096:
                yield batched(done)
                done = []
        if now:
            yield batched([*done, now])

    read_back = pages(files, keys, column)
    return read_back.mapInArrow(run, f"{_kinds(read_back, keys)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
