"""Page images: portable anymaps, PNG and PDF, as a data source with a row for each page, and writers.

``spark.dataSource.register(PageImages)`` gives the format ``page_images``. A task reads some small files whole, or every
n-th page of a large file of several pages, so neither many files nor one large one meet in a task. A ZIP archive (``.zip``)
stands for the files in it, of which a task reads one at a time, of a large archive every n-th; a file's path is the
archive's and its own. Pages come as RGB
samples of 8 bits, those of PDF files with their text layer, and without samples where no scan fills them. A file that cannot be read, or of which a page is broken, gives a row with ``error`` there; the
pages before it stay.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, page_index int, page_count int, width int, height int, pixels binary, text string, error string"
TASK_BYTES = 32 << 20
MOST_PIXELS = 1 << 28
MOST_BYTES = 1 << 30  # of a file in an archive
ARCHIVED = 2000  # files of an archive
SMALL = 1 << 20  # bytes of rows of the two filters that need all neighbours, below which rows are done one by one
OPEN_BYTES = 1 << 19  # what opening a file weighs
BATCH_BYTES = 1 << 22
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of PNG's colour types
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))  # of interlaced PNG: x, y, steps


class BadImage(ValueError):
    """What is wrong with a file."""


def _average(row: np.ndarray, up: np.ndarray) -> None:
    """Undo the average filter in place (pixels x channels). Where nothing is added and the row above is of one colour, a
    pixel that has that colour passes it on, so such runs are filled at once."""
    quiet = np.zeros(len(row) + 1, bool)
    quiet[1:-1] = ~row[1:].any(axis=1) & (up[1:] == up[:-1]).all(axis=1)
    stops = np.flatnonzero(~quiet)  # the end is one
    ends = stops[np.searchsorted(stops, np.arange(len(row)))].tolist()
    raw, above, left, x = row.tolist(), up.tolist(), [0] * row.shape[1], 0
    while x < len(raw):
        end = ends[x]
        if end > x and left == above[x]:
            row[x:end] = left
            x = end
            continue
        left = [byte + (a + b >> 1) & 255 for byte, a, b in zip(raw[x], left, above[x])]
        row[x] = left
        x += 1


def _paeth(row: np.ndarray, up: np.ndarray) -> None:
    """Undo the Paeth filter in place (pixels x channels). Where the row above keeps its colour, the pixel to the left is what
    is added to: a sum. Only the other pixels are taken one by one."""
    sums = np.cumsum(row, axis=0, dtype=np.uint8)
    turns = np.concatenate([[0], np.flatnonzero((up[1:] != up[:-1]).any(axis=1)) + 1])
    at, before = row[turns].tolist(), np.maximum(turns - 1, 0)
    here, was, above, corner = sums[turns].tolist(), sums[before].tolist(), up[turns].tolist(), up[before].tolist()
    zero, shifts = [0] * row.shape[1], []
    for k, bytes_ in enumerate(at):
        left = [(s + d) & 255 for s, d in zip(was[k], shifts[-1])] if k else zero
        shift = []
        for byte, s, a, b, c in zip(bytes_, here[k], left, above[k], corner[k] if k else zero):
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            shift.append(byte + (a if p <= q and p <= r else b if q <= r else c) - s)
        shifts.append(shift)
    runs = np.diff(np.append(turns, len(row)))
    row[:] = sums + np.repeat((np.array(shifts) & 255).astype(np.uint8), runs, axis=0)


def _row_by_row(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows that repeat under an equal row above, as those of blank paper do, are undone once a page."""
    out, known = raw.copy(), {}
    above = np.zeros(raw.shape[1], np.uint8)
    over, whole = above.tobytes(), out.tobytes()  # the same rows as bytes
    line = raw.shape[1]
    for k, (row, kind) in enumerate(zip(out, kinds.tolist())):
        key = (kind, whole[k * line : (k + 1) * line], over)
        found = known.get(key)
        if found is not None:
            row[:] = above = found[0]
            over = found[1]
            continue
        if kind == 1:
            cells = row.reshape(-1, step)
            cells[:] = np.cumsum(cells, axis=0, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind > 2:
            (_average if kind == 3 else _paeth)(row.reshape(-1, step), above.reshape(-1, step))
        above, over = row, row.tobytes()
        known[key] = above, over
    return out


def unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG's five row filters. A byte needs its left, upper and upper left neighbours, ``step`` bytes away, so the
    cells of one diagonal are independent: they are done together, each by its own row's filter."""
    height, line = raw.shape
    if not np.isin(kinds, (0, 1, 2, 3, 4)).all():
        raise BadImage("an unknown row filter")
    if line * np.isin(kinds, (3, 4)).sum() < SMALL:  # a small image has more diagonals than it is worth: row by row
        return _row_by_row(raw, kinds, step)
    width = line // step
    y, x = np.arange(height), np.arange(width)
    skew = np.zeros((height + width + 1, height + 1, step), np.int16)  # two empty diagonals before, an empty row before
    skew[(x[None, :] + y[:, None]) + 2, y[:, None] + 1] = raw.reshape(height, width, step)
    kind = np.concatenate([[0], kinds])[:, None]
    for d in range(2, height + width + 1):
        first, last = max(1, d - 1 - width + 1), min(height, d - 1) + 1  # rows of this diagonal, from 1
        rows, above = slice(first, last), slice(first - 1, last - 1)
        k = kind[rows]
        left, up, corner = skew[d - 1, rows], skew[d - 1, above], skew[d - 2, above]
        base = left + up - corner
        a, b, c = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        skew[d, rows] = (skew[d, rows] + np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) >> 1, paeth], 0)) & 255
    return skew[(x[None, :] + y[:, None]) + 2, y[:, None] + 1].astype(np.uint8).reshape(height, line)


def _samples(data: bytes, at: int, width: int, height: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    """height x width x channels samples of 8 or 16 bits, and where the next pass begins."""
    line = (width * channels * bits + 7) // 8
    size = height * (line + 1)
    rows = np.frombuffer(data, np.uint8, size, at).reshape(height, line + 1) if len(data) >= at + size else None
    if rows is None:
        raise BadImage("too few bytes of pixels")
    step = max(1, channels * bits // 8)
    raw = unfiltered(rows[:, 1:], rows[:, 0], step)
    if bits == 16:
        return raw.reshape(height, width, channels, 2)[..., 0], at + size  # the high byte
    if bits == 8:
        return raw.reshape(height, width, channels), at + size
    cells = np.unpackbits(raw, axis=1)[:, : width * channels * bits].reshape(height, width, channels, bits)
    return (cells << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8), at + size


def png(data: bytes) -> np.ndarray:
    """RGB of a PNG file; transparent pixels keep their colour."""
    at, header, palette, packed, ended = len(SIGNATURE), None, None, [], False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise BadImage("a chunk beyond the end")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadImage(f"a wrong checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body) if size == 13 else None
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8)[: size // 3 * 3].reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise BadImage("no header or no end")
    width, height, bits, colour, _, _, interlaced = header
    if colour not in CHANNELS or bits not in (1, 2, 4, 8, 16) or not width or not height:
        raise BadImage("an unknown kind of pixels")
    if width * height > MOST_PIXELS:
        raise BadImage("more pixels than allowed")
    most = (width * height * CHANNELS[colour] * bits + 7) // 8 + 16 * height + 64 * width + 64
    bytes_ = zlib.decompressobj().decompress(b"".join(packed), most)
    if interlaced:
        found, at = np.zeros((height, width, CHANNELS[colour]), np.uint8), 0
        for x, y, across, down in PASSES:
            w, h = -(-(width - x) // across), -(-(height - y) // down)
            if w > 0 and h > 0:
                found[y::down, x::across], at = _samples(bytes_, at, w, h, CHANNELS[colour], bits)
    else:
        found, _ = _samples(bytes_, 0, width, height, CHANNELS[colour], bits)
    if colour == 3:
        if palette is None or found.max() >= len(palette):
            raise BadImage("a colour beyond the palette")
        return palette[found[..., 0]]
    if bits < 8:
        found = (found.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return np.repeat(found[..., :1], 3, axis=2) if colour in (0, 4) else np.ascontiguousarray(found[..., :3])


def anymap_pages(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(channels, width, height, greatest sample, place of the samples) of each image of a raw anymap file."""
    at = 0
    while at < len(data):
        channels = {b"P5": 1, b"P6": 3}.get(data[at : at + 2])
        numbers, at = [], at + 2
        while channels and len(numbers) < 3 and at < len(data):
            if data[at : at + 1] == b"#":
                at = data.find(b"\n", at) if b"\n" in data[at : at + 4096] else len(data)
            elif data[at : at + 1].isdigit():
                end = at
                while data[end : end + 1].isdigit() and end - at < 10:
                    end += 1
                numbers.append(int(data[at:end]))
                at = end
            elif data[at : at + 1].isspace():
                at += 1
            else:
                break
        if len(numbers) < 3 or not data[at : at + 1].isspace():
            raise BadImage("no header of an anymap")
        width, height, top = numbers
        if not (0 < width and 0 < height and 0 < top < 65536) or width * height > MOST_PIXELS:
            raise BadImage("sizes out of range")
        size = width * height * channels * (2 if top > 255 else 1)
        if at + 1 + size > len(data):
            raise BadImage("too few bytes of pixels")
        yield channels, width, height, top, at + 1
        at += 1 + size
        while data[at : at + 1].isspace():
            at += 1


def _anymap(data: bytes, channels: int, width: int, height: int, top: int, at: int) -> np.ndarray:
    raw = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height * channels, at).reshape(height, width, channels)
    scaled = raw if top == 255 else ((raw.astype(np.uint32) * 255 + top // 2) // top).astype(np.uint8)
    return np.repeat(scaled, 3, axis=2) if channels == 1 else scaled


def decoded(data: bytes | None, part: int = 0, parts: int = 1) -> Iterator[tuple[int, int | None, np.ndarray | None, str | None, str | None]]:
    """(page, pages, RGB, text layer, error) of every ``parts``-th page of a file, from ``part`` on. A fault ends the file,
    but that of a page of a PDF file is its own."""
    page, places = 0, []
    try:
        if data is None:
            raise BadImage("no file")
        if data.startswith(SIGNATURE):
            if part == 0:
                yield 0, 1, png(data), None, None
            return
        if data.startswith(b"%PDF"):
            from docketry.sources import pdf

            found = pdf.read(data)
            for page in range(part, len(found), parts):
                text, image, error = found[page]
                yield page, len(found), image, text, error
            return
        if not data.startswith((b"P5", b"P6")):
            raise BadImage("neither PNG, PDF nor a raw anymap")
        fault = None
        try:
            places += anymap_pages(data)
        except BadImage as problem:
            places, fault = _before(data), problem
        for page in range(part, len(places), parts):
            yield page, len(places), _anymap(data, *places[page]), None, None
        if fault and part == 0:
            page = len(places)
            raise fault
    except (BadImage, zlib.error, struct.error, ValueError, TypeError, RecursionError) as problem:  # whatever is in the bytes
        if part == 0:
            yield page, len(places) or None, None, None, str(problem)


def _before(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """The whole pages before a fault."""
    found = []
    try:
        for place in anymap_pages(data):
            found.append(place)
    except BadImage:
        pass
    return found


@dataclass
class Files(InputPartition):
    """Files of a task, and which of their pages it reads."""

    paths: list[str]
    part: int = 0
    parts: int = 1


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system that reads and writes ``path``, and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class PageReader(DataSourceReader):
    def __init__(self, folder: str, task_bytes: int):
        self.folder, self.task_bytes = folder, task_bytes

    def partitions(self) -> list[InputPartition]:
        files, top = file_system(self.folder)
        listed = files.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
        found, small, held = [], [], 0
        for info in sorted((i for i in listed if i.is_file), key=lambda i: i.path):
            if info.size > self.task_bytes or archived(info.path):  # an archive holds many pages in few bytes
                parts = -(-max(info.size, 1) // self.task_bytes)
                found += [Files([info.path], part, parts) for part in range(parts)]
                continue
            weight = info.size + OPEN_BYTES
            if small and held + weight > self.task_bytes:
                found.append(Files(small))
                small, held = [], 0
            small.append(info.path)
            held += weight
        return [*found, Files(small)] if small or not found else found

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.folder)

        def contents() -> Iterator[tuple[str, bytes]]:
            for path in partition.paths:
                with files.open_input_file(path) as source:
                    yield path, source.read()

        if partition.paths and archived(partition.paths[0]):
            with files.open_input_file(partition.paths[0]) as source:
                yield from page_rows(unpacked(partition.paths[0], source, partition.part, partition.parts))
        else:
            yield from page_rows(contents(), partition.part, partition.parts)


def archived(path: str) -> bool:
    return path.lower().endswith(".zip")


def unpacked(path: str, source: io.IOBase | pa.NativeFile, part: int = 0, parts: int = 1) -> Iterator[tuple[str, bytes | str]]:
    """(path, bytes) of every ``parts``-th file of an archive, from ``part`` on; in place of bytes what is wrong with it. An
    archive that cannot be read is a file with a fault."""
    try:
        archive = zipfile.ZipFile(source)
        found = [i for i in archive.infolist() if not i.is_dir()]
    except BROKEN as problem:
        if part == 0:
            yield path, str(problem)
        return
    for info in found[part::parts]:
        try:
            if info.file_size > MOST_BYTES:
                raise BadImage("more bytes than allowed")
            content = archive.read(info)
        except BROKEN as problem:
            content = str(problem)
        yield f"{path}/{info.filename}", content


#: What a broken or foreign archive raises, one with a password or an unknown packing among them.
BROKEN = (BadImage, zipfile.BadZipFile, zlib.error, struct.error, ValueError, EOFError, RuntimeError, NotImplementedError)


def page_rows(contents: Iterator[tuple[str, bytes | str | None]], part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """The pages of files (path, bytes or what is wrong with them), about ``BATCH_BYTES`` of pixels at a time."""
    rows, held = [], 0
    for path, content in contents:
        for page, pages, image, text, error in [(0, None, None, None, content)] if isinstance(content, str) else decoded(content, part, parts):
            height, width = image.shape[:2] if image is not None else (None, None)
            rows.append((path, path.rsplit("/", 1)[-1], page, pages, width, height, image.tobytes() if image is not None else None, text, error))
            held += 1024 + (image.size if image is not None else 0)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES)


_KINDS = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.binary(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class PageImages(DataSource):
    """Options: ``path``, a folder that driver and executors share; ``task_bytes``, what a task reads at least."""

    @classmethod
    def name(cls) -> str:
        return "page_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def page_images(spark: SparkSession, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A row for each page of the image files below ``folder``."""
    spark.dataSource.register(PageImages)
    return spark.read.format("page_images").option("task_bytes", str(task_bytes)).load(folder)


def pages_of(files: DataFrame) -> DataFrame:
    """The same rows of files (path, content) that Spark has read, where only Spark reaches the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = ((path, content.as_py()) for path, content in zip(batch.column(0).to_pylist(), batch.column(1)))
            yield from page_rows(file for path, content in given for file in (unpacked(path, io.BytesIO(content)) if content is not None and archived(path) else [(path, content)]))

    return files.select("path", F.col("content")).mapInArrow(run, SCHEMA)


def as_png(image: np.ndarray) -> bytes:
    """RGB as a PNG file; the rows take the five filters in turn."""
    height, width, _ = image.shape
    wide = np.zeros((height + 1, width + 1, 3), np.int16)
    wide[1:, 1:] = image
    raw = np.empty((height, 1 + 3 * width), np.uint8)
    raw[:, 0] = np.arange(height) % 5
    for kind in range(5):
        here, left, up, corner = wide[1 + kind :: 5, 1:], wide[1 + kind :: 5, :-1], wide[kind:-1:5, 1:], wide[kind:-1:5, :-1]
        if kind < 4:
            off = (0, left, up, (left + up) >> 1)[kind]
        else:
            a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            off = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        raw[kind::5, 1:] = ((here - off) & 255).reshape(len(here), 3 * width)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def as_anymap(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row (name, content) as a file of ``folder``, from the executors; returns how many. A file is put in
    place whole, so that a task that runs again leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(folder)
        files.create_dir(top, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_output_stream(f"{top}/{name}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_archives(rows: DataFrame, folder: str, most: int = ARCHIVED) -> int:
    """Write rows (name, content) as files of ZIP archives in ``folder``, at most ``most`` each, from the executors; returns how
    many. An archive is put in place whole. A task that runs again writes the same ones if its rows come in one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(folder)
        files.create_dir(top, recursive=True)
        given = ((name, content) for batch in batches for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        n, task = 0, TaskContext.get().partitionId()
        while own := list(islice(given, most)):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                for name, content in own:
                    archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_STORED if content.startswith(SIGNATURE) else zipfile.ZIP_DEFLATED)
            with files.open_output_stream(f"{top}/{task:05}-{n // most:05}.zip") as out:
                out.write(held.getbuffer())
            n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
