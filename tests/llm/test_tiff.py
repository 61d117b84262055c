"""Files of pages: codecs, directories, damage, and the round trip of texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from docketry.llm import tiff
from docketry.llm.queries import op12_tiff_media
from docketry.llm.tiff import Page, features, lzw_decode, lzw_encode, media, pack_bits, pages, read, store, unpack_bits, write


def bits(*codes):
    """Codes (value, bits), high bit first."""
    text = "".join(f"{c:0{n}b}" for c, n in codes)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def test_published_examples():
    # the examples of the format's specification
    assert unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert lzw_decode(bits(*((c, 9) for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_codecs_round_trip():
    rng = random.Random(1)
    cases = [b"", b"a", b"aaaa", bytes(range(256)) * 40, b"\0" * 70_000, bytes(rng.randrange(256) for _ in range(40_000)), b"".join(rng.choice([b"ab", b"abc", b"\0"]) for _ in range(60_000))]
    for data in cases:
        assert lzw_decode(lzw_encode(data)) == data
        for width in (1, 5, 64, 300):
            if len(data) >= width:
                image = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, width)
                packed = pack_bits(image)
                assert unpack_bits(packed) == image.tobytes()
                assert len(packed) <= image.size + len(image) * (-(-width // 128) + 1) + image.size // 3


def test_long_segments_without_clear_code():
    data = [random.Random(2).randrange(256) for _ in range(9000)]
    # an encoder that never adds an entry it uses: each code a single byte, widths growing with the decoder's table
    widths = [9] * 254 + [10] * 512 + [11] * 1024
    codes = [(256, 9)] + [(c, widths[k] if k < len(widths) else 12) for k, c in enumerate(data)]
    k = len(data)
    assert lzw_decode(bits(*codes, (257, 12 if k >= len(widths) else widths[k]))) == bytes(data)


def handmade(order, fields, blobs, big=False, extra=b""):
    """One directory; the values of ``blobs`` fields are offsets of the given bytes."""
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, 0) if big else struct.pack(f"{order}HI", 42, 0)))
    at = []
    for blob in blobs:
        at.append(len(out))
        out += blob
    word, entry = ("Q", "Q") if big else ("I", "H")
    entries = []
    for tag, kind, values in sorted(fields(at)):
        code = {3: "H", 4: "I", 16: "Q"}[kind]
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        room = struct.calcsize(f"={word}")
        if len(raw) > room:
            place, raw = len(out), out.extend(raw) or struct.pack(f"{order}{word}", len(out) - len(raw))
            assert struct.unpack(f"{order}{word}", raw)[0] == place
        entries.append(struct.pack(f"{order}HH{word}", tag, kind, len(values)) + raw.ljust(room, b"\0"))
    struct.pack_into(f"{order}{word}", out, 8 if big else 4, len(out))
    out += struct.pack(f"{order}{entry}", len(entries)) + b"".join(entries) + struct.pack(f"{order}{word}", 0) + extra
    return bytes(out)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_layouts(order, big):
    rng = np.random.default_rng(6)
    image = rng.integers(0, 60_000, (21, 19, 3)).astype("u2")
    wide = image.astype(f"{order}u2")
    # planes apart, strips of 8 rows, differences between neighbours, deflate
    def plane(c, y):
        part = image[y : y + 8, :, c]
        return zlib.compress(np.hstack([part[:, :1], np.diff(part, axis=1)]).astype(f"{order}u2").tobytes())

    blobs = [plane(c, y) for c in range(3) for y in range(0, 21, 8)]
    file = handmade(order, lambda at: [(256, 3, [19]), (257, 4, [21]), (258, 3, [16] * 3), (259, 3, [8]), (277, 3, [3]), (284, 3, [2]), (317, 3, [2]), (278, 3, [8]), (273, 16 if big else 4, at), (279, 4, [len(b) for b in blobs])], blobs, big)
    (page,) = read(file)
    assert isinstance(page, Page) and page.samples == image.astype("<u2").tobytes() and (page.channels, page.bits) == (3, 16)
    # tiles of 16 x 16, channels together, LZW
    tiles = []
    for y in (0, 16):
        for x in (0, 16):
            part = np.zeros((16, 16, 3), f"{order}u2")
            cut = wide[y : y + 16, x : x + 16]
            part[: cut.shape[0], : cut.shape[1]] = cut
            tiles.append(lzw_encode(part.tobytes()))
    file = handmade(order, lambda at: [(256, 3, [19]), (257, 3, [21]), (258, 3, [16] * 3), (259, 3, [5]), (277, 3, [3]), (322, 3, [16]), (323, 3, [16]), (324, 4, at), (325, 4, [len(t) for t in tiles])], tiles, big)
    (page,) = read(file)
    assert page.samples == image.astype("<u2").tobytes()
    # one bit a sample, rows filled up to whole bytes, stored low bit first
    mask = rng.integers(0, 2, (5, 11)).astype(np.uint8)
    raw = np.packbits(mask, axis=1, bitorder="little").tobytes()
    (page,) = read(handmade(order, lambda at: [(256, 3, [11]), (257, 3, [5]), (266, 3, [2]), (273, 4, at), (279, 4, [len(raw)])], [raw], big))
    assert page.samples == mask.tobytes()


def test_damage():
    good = np.arange(64 * 70, dtype=np.uint8).reshape(70, 64)
    file = write([(good, tiff.DEFLATE, 2, 0), (good[:3], tiff.LZW, 1, 16), (good, tiff.PACKBITS, 1, 0), (good, tiff.STORED, 2, 32)])
    assert [p.samples for p in read(file)] == [good.tobytes(), good[:3].tobytes(), good.tobytes(), good.tobytes()]
    assert list(read(None)) == ["no file"] and list(read(b"")) == ["no such file"] and list(read(b"II*\0")) == ["no such file"]
    # the first page's data is spoilt, the others stay
    broken = list(read(file[:8] + b"\xff" * 40 + file[48:]))
    assert isinstance(broken[0], str) and [p.samples for p in broken[1:]] == [good[:3].tobytes(), good.tobytes(), good.tobytes()]
    # the chain of directories leads back to the first
    first = struct.unpack_from("<I", file, 4)[0]
    n = struct.unpack_from("<H", file, first)[0]
    circle = bytearray(file)
    struct.pack_into("<I", circle, first + 2 + 12 * n, first)
    assert [isinstance(p, Page) or p for p in read(bytes(circle))] == [True, "directories in a circle"]
    for cut in range(0, len(file), 97):  # never anything but pages and faults
        assert all(isinstance(p, (Page, str)) for p in read(file[:cut]))
    rng = random.Random(8)
    for _ in range(300):
        spoilt = bytearray(file)
        for _ in range(5):
            spoilt[rng.randrange(len(file))] = rng.randrange(256)
        assert all(isinstance(p, (Page, str)) for p in read(bytes(spoilt)))


def wanted(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_texts_round_trip(spark):
    texts = [None, "", "a", "x" * 64, "é" * 32, "long " * 100_000, "same", "same", "\0" * 200, "z" * 16_384, "z" * 16_385, "ab" * 8200]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "q", "m"), (2, "a", "m")], "doc_id long, text string, media string")
    files = media(docs)
    assert [tuple(r) for r in files.select("doc_id", "n_bytes").limit(3).collect()] == [(0, 0), (1, 0), (2, 1)]
    got = features(files).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "q" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == wanted(text)
    assert len({r[1:] for r in got if r.doc_id in (6, 7)}) == 1
    long = pages(files).where("doc_id = 5").drop("samples").collect()
    assert [r.page for r in long] == list(range(len(long))) and {r.compression for r in long} == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW}
    assert features(files.limit(0)).collect() == [] and pages(files.limit(0)).collect() == []


def test_files_with_faults_are_rows(spark):
    file = store(b"x" * 100)
    rows = [(1, file), (2, None), (3, b"junk"), (4, file[: len(file) // 2]), (None, file)]
    files = spark.createDataFrame(rows, "page long, media binary")
    with pytest.raises(Exception):
        pages(files.select("media"), ("page",))
    found = pages(files.withColumnRenamed("page", "id"), ("id",)).collect()
    assert sorted((r.id or 0, r.error is None) for r in found) == [(0, True), (1, True), (2, False), (3, False), (4, False)]
    told = features(files.withColumnRenamed("page", "id"), ("id",)).collect()
    assert sorted((r.id or 0, r.payload_bytes, r.feature.startswith("broken")) for r in told) == [(0, 128, False), (1, 128, False), (2, None, True), (3, None, True), (4, None, True)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_tiff_media(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == wanted(texts[r.doc_id])
        file = store((texts[r.doc_id] or "").encode())
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
