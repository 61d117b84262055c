"""Page images: decoding against plain loops, clean-up and outlines against brute force, the data source."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from docketry.functions import imaging as I
from docketry.operators import imaging
from docketry.sources import images
from docketry.sources.images import as_anymap, as_png, decoded, page_images, pages_of, png, unfiltered, write_archives, write_files


def plain_unfilter(raw, kinds, step):
    out = np.zeros(raw.shape, int)
    for y in range(raw.shape[0]):
        for x in range(raw.shape[1]):
            left = out[y, x - step] if x >= step else 0
            up = out[y - 1, x] if y else 0
            corner = out[y - 1, x - step] if y and x >= step else 0
            p = left + up - corner
            by = sorted(((abs(p - v), k, v) for k, v in enumerate((left, up, corner))))[0][2]
            out[y, x] = (int(raw[y, x]) + (0, left, up, (left + up) // 2, by)[kinds[y]]) & 255
    return out.astype(np.uint8)


@pytest.mark.parametrize("step", [1, 2, 3, 4, 6, 8])
@pytest.mark.parametrize("small", [0, 1 << 20])  # by diagonals, row by row
def test_row_filters(step, small, monkeypatch):
    monkeypatch.setattr(images, "SMALL", small)
    rng = np.random.default_rng(step)
    for height, width, most in ((1, 1, 4), (7, 5, 4), (5, 9, 4), (12, 4, 2)):
        raw = rng.integers(0, 256, (height, width * step)).astype(np.uint8)
        kinds = rng.integers(0, most + 1, height)
        assert (unfiltered(raw, kinds, step) == plain_unfilter(raw, kinds, step)).all()


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def handmade(rows, width, height, bits, colour, extra=b"", interlaced=0):
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)
    return images.SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_kinds_of_pixels():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (13, 11, 3)).astype(np.uint8)
    assert (png(as_png(rgb)) == rgb).all()
    lines = lambda a: b"".join(b"\0" + r.tobytes() for r in a.reshape(len(a), -1))
    grey = rgb[..., :1]
    assert (png(handmade(lines(grey), 11, 13, 8, 0)) == grey).all()
    alpha = np.concatenate([rgb, grey], axis=2)
    assert (png(handmade(lines(alpha), 11, 13, 8, 6)) == rgb).all()
    assert (png(handmade(lines(rgb.astype(">u2") * 257), 11, 13, 16, 2)) == rgb).all()
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    index = rng.integers(0, 16, (13, 11)).astype(np.uint8)
    packed = np.packbits(np.unpackbits(index[..., None], axis=2)[:, :, 4:].reshape(13, -1), axis=1)
    assert (png(handmade(lines(packed), 11, 13, 4, 3, chunk(b"PLTE", palette.tobytes()))) == palette[index]).all()
    bit = rng.integers(0, 2, (13, 11)).astype(np.uint8)
    assert (png(handmade(lines(np.packbits(bit, axis=1)), 11, 13, 1, 0)) == bit[..., None] * 255).all()
    woven = b"".join(lines(rgb[y::down, x::across]) for x, y, across, down in images.PASSES if rgb[y::down, x::across].size)
    assert (png(handmade(woven, 11, 13, 8, 2, interlaced=1)) == rgb).all()


def test_damaged_files():
    rgb = np.zeros((4, 4, 3), np.uint8)
    good, three = as_png(rgb), as_anymap(rgb) * 3
    assert [(p, n, e) for p, n, _, _, e in decoded(three)] == [(0, 3, None), (1, 3, None), (2, 3, None)]
    assert [p for k in range(2) for p, *_ in decoded(three, k, 2)] == [0, 2, 1]
    assert [(p, e) for p, _, _, _, e in decoded(three[:-1])] == [(0, None), (1, None), (2, "too few bytes of pixels")]
    assert [e for *_, e in decoded(None)] == ["no file"] and [e for *_, e in decoded(b"GIF8")] == ["neither PNG, PDF nor a raw anymap"]
    wide = b"P5 # a remark\n2 2\n1023\n" + np.array([0, 511, 512, 1023], ">u2").tobytes()
    assert next(decoded(wide))[2][..., 0].tolist() == [[0, 127], [128, 255]]
    rng = random.Random(3)
    for file in (good, three):
        for _ in range(200):
            spoilt = bytearray(file)
            spoilt[rng.randrange(len(file))] = rng.randrange(256)
            list(decoded(bytes(spoilt[: rng.randrange(1, len(file))])))


def test_pdf_pages():
    from docketry.sources import pdf

    rng = np.random.default_rng(12)
    scan = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    file = pdf.write([("Tractor (new) \\ model\nTotal: 5", scan), ("second", None), ("", scan[:3])])
    got = list(decoded(file))
    assert [(p, n, t, e) for p, n, _, t, e in got] == [(0, 3, "Tractor (new) \\ model\nTotal: 5", None), (1, 3, "second", None), (2, 3, None, None)]
    assert (got[0][2] == scan).all() and got[1][2] is None and (got[2][2] == scan[:3]).all()
    assert [p for k in range(2) for p, *_ in decoded(file, k, 2)] == [0, 2, 1]
    # by hand: objects in a packed stream, inherited resources, a row-filtered grey scan, text in arrays, hex and octal
    line = np.concatenate([np.array([[2], [2]], np.uint8), np.array([[9, 8, 7], [1, 1, 1]], np.uint8)], axis=1)
    inner = [b"<< /Type /Catalog /Pages 11 0 R >>", b"<< /Type /Pages /Kids [12 0 R] /Resources << /XObject << /A 5 0 R >> >> >>", b"<< /Type /Page /Parent 11 0 R /Contents [4 0 R] >>"]
    heads, body = b"", b""
    for k, part in enumerate(inner):
        heads += b"%d %d " % (10 + k, len(body))
        body += part + b" "
    stream = lambda head, data: b"<< %s /Length %d /Filter /FlateDecode >> stream\r\n" % (head, len(zlib.compress(data))) + zlib.compress(data) + b"\nendstream"
    objects = {3: stream(b"/Type /ObjStm /N 3 /First %d" % len(heads), heads + body), 4: stream(b"", b"BT [(Gr\\141nd) -20 ( T) <6F74>] TJ (al) Tj ET % remark\nBT (50 \\(HP\\)) Tj ET"), 5: stream(b"/Subtype /Image /Width 3 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray /DecodeParms << /Predictor 15 /Columns 3 >>", line.tobytes())}
    hand = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items())
    ((_, pages, image, text, error),) = decoded(hand)
    assert (pages, text, error) == (1, "Grand Total\n50 (HP)", None) and image[..., 0].tolist() == [[9, 8, 7], [10, 9, 8]]
    photo = file.replace(b"/Filter /FlateDecode", b"/Filter /DCTDecode  ")
    assert all(e and "DCT" in e for *_, e in decoded(photo))
    assert [e for *_, e in decoded(b"%PDF-1.4 junk")] == ["no objects"] and [e for *_, e in decoded(file.replace(b"/Root 1 0 R", b"/Encrypt 9 0 R"))] == ["an encrypted file"]
    spin = random.Random(5)
    for whole in (file, hand):
        for _ in range(300):
            spoilt = bytearray(whole)
            for _ in range(3):
                spoilt[spin.randrange(len(whole))] = spin.randrange(256)
            list(decoded(bytes(spoilt[: spin.randrange(8, len(whole) + 1)])))
    assert list(decoded(b"%PDF 1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R] >> endobj"))[0][4] == "no pages"


def test_data_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 256, (10, 8, 3)).astype(np.uint8) for _ in range(7)]
    files = [("one.png", as_png(pages[0])), ("many.ppm", b"".join(map(as_anymap, pages))), ("bad.png", as_png(pages[1])[:60]), ("note.txt", b"hello"), ("empty.png", b"")]
    folder = str(tmp_path / "scans")
    assert write_files(spark.createDataFrame(files, "name string, content binary"), folder) == 5
    for size in (10, 200, 1 << 20):  # from every page its own task to one task
        got = {(r.name, r.page_index): r for r in page_images(spark, folder, size).collect()}
        assert len(got) == 1 + 7 + 3
        assert got["one.png", 0].pixels == pages[0].tobytes()
        assert [bytes(got["many.ppm", k].pixels) for k in range(7)] == [p.tobytes() for p in pages]
        assert all(got[n, 0].error and got[n, 0].pixels is None for n in ("bad.png", "note.txt", "empty.png"))
    read = spark.createDataFrame([(f"{folder}/{n}", c) for n, c in files] + [("gone", None)], "path string, content binary")
    assert sorted((r.name, r.page_index, r.error) for r in pages_of(read).collect()) == sorted([(*k, r.error) for k, r in got.items()] + [("gone", 0, "no file")])
    assert page_images(spark, str(tmp_path / "nothing")).count() == 0


def plain_otsu(image):
    best, at = 0.0, 0
    for t in range(256):
        low, high = image[image <= t].astype(float), image[image > t].astype(float)
        if len(low) and len(high):
            v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if v > best * (1 + 1e-12):
                best, at = v, t
    return at


def test_threshold():
    rng = np.random.default_rng(4)
    for make in (lambda: rng.integers(0, 256, 300), lambda: np.clip(rng.normal(rng.choice([60, 190], 400), 20), 0, 255), lambda: rng.choice([9, 200, 255], 50), lambda: np.full(9, 7)):
        image = make().astype(np.uint8).reshape(1, -1)
        assert I.otsu(image) == plain_otsu(image)


def test_hull_and_angle():
    rng = np.random.default_rng(5)
    for _ in range(40):
        points = rng.integers(0, 12, (rng.integers(1, 40), 2))
        corners = I.hull(points)
        for p in points:  # no point outside, every corner a point
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in zip(corners, np.roll(corners, -1, axis=0))) if len(corners) > 2 else True
        assert {tuple(c) for c in corners} <= {tuple(p) for p in points}
        if len(corners) > 2:
            angle = I.box_angle(points)
            area = lambda d: np.ptp(points @ [math.cos(d), math.sin(d)]) * np.ptp(points @ [-math.sin(d), math.cos(d)])
            assert -45 < angle <= 45 and area(math.radians(angle)) <= min(area(math.radians(d / 4)) for d in range(360)) + 1e-6


def tilted(degrees, size=(300, 400)):
    """A dark bar that descends to the right by ``degrees``."""
    y, x = np.mgrid[: size[0], : size[1]] - np.array([[[size[0] / 2]], [[size[1] / 2]]])
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    image = np.full((*size, 3), 255, np.uint8)
    image[(np.abs(c * x + s * y) < 120) & (np.abs(c * y - s * x) < 40)] = 0
    return image


@pytest.mark.parametrize("degrees", [-9.0, -3.0, -0.2, 0.0, 0.3, 2.0, 7.0, 14.0, 30.0])
def test_deskew_within_its_range(degrees):
    straight, angle = I.deskewed(tilted(degrees))
    if 0.5 <= abs(degrees) <= 10:
        assert angle == pytest.approx(degrees, abs=0.35)
        assert abs(I.skew(I.grey(straight))) < 0.4
    else:
        assert angle == 0.0 and (straight == tilted(degrees)).all()
    assert I.skew(np.full((5, 5), 255, np.uint8)) == 0.0


def test_turning_equals_a_plain_loop():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (9, 12, 3)).astype(np.uint8)
    got = I.turned(image, 4.0, band=4)
    weight = lambda d: (1.25 * d - 2.25) * d * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3 if d < 2 else 0.0
    c, s = math.cos(math.radians(4)), math.sin(math.radians(4))
    for y in range(9):
        for x in range(12):
            u, v = c * (x - 6) - s * (y - 4.5) + 6, s * (x - 6) + c * (y - 4.5) + 4.5
            total = sum(weight(abs(v - j)) * weight(abs(u - i)) * image[min(max(j, 0), 8), min(max(i, 0), 11)].astype(float) for j in range(math.floor(v) - 1, math.floor(v) + 3) for i in range(math.floor(u) - 1, math.floor(u) + 3))
            assert np.abs(np.clip(total, 0, 255) - got[y, x]).max() <= 0.5 + 1e-6


def test_noise_equals_a_plain_loop():
    rng = np.random.default_rng(7)
    plane = np.clip(rng.normal(128, 6, (10, 11)), 0, 255).astype(np.uint8)
    got = I.denoised(plane, h=9, template=3, search=5)
    wide = np.pad(plane.astype(float), 3, mode="reflect")
    for y in range(10):
        for x in range(11):
            here = wide[y + 2 : y + 5, x + 2 : x + 5]
            pairs = [(math.exp(-((wide[y + dy : y + dy + 3, x + dx : x + dx + 3] - here) ** 2).mean() / 81), wide[y + dy + 1, x + dx + 1]) for dy in range(5) for dx in range(5)]
            pairs = [(w, v) for w, v in pairs if w >= 0.001]
            assert abs(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs) - got[y, x]) <= 0.5 + 1e-6


def test_contrast_levels():
    rng = np.random.default_rng(8)
    for tile in (rng.integers(100, 110, (16, 16)), rng.integers(0, 256, (20, 13)), np.full((8, 8), 40)):
        tile = tile.astype(np.uint8)
        count = [int((tile == v).sum()) for v in range(256)]
        most = max(int(2.0 * tile.size / 256), 1)
        over = sum(max(c - most, 0) for c in count)
        count = [min(c, most) + over // 256 for c in count]
        rest = over % 256
        for v in range(0, 256, max(256 // rest, 1) if rest else 256):
            if rest:
                count[v] += 1
                rest -= 1
        assert sum(count) == tile.size
        want = [round(255 * sum(count[: v + 1]) / tile.size) for v in range(256)]
        assert np.abs(I.tile_levels(tile).astype(int) - want).max() <= 1
    flat = np.full((40, 48), 90, np.uint8)
    assert len(np.unique(I.equalised(flat))) == 1
    faint = (100 + 10 * rng.random((64, 64))).astype(np.uint8)
    assert np.ptp(I.equalised(faint)) > np.ptp(faint)
    assert I.equalised(np.array([[5]], np.uint8)).shape == (1, 1)


def test_colours():
    rng = np.random.default_rng(9)
    rgb = rng.integers(0, 256, (30, 30, 3)).astype(np.uint8)
    assert np.abs(I.join_luminance(*I.split_luminance(rgb)).astype(int) - rgb).max() <= 3
    import colorsys

    h, s, v = I.hue(rgb)
    for k in range(0, 30):
        a, b, c = colorsys.rgb_to_hsv(*(rgb[k, k] / 255))
        assert min(abs(int(h[k, k]) - a * 180), 180 - abs(int(h[k, k]) - a * 180)) <= 0.51 and abs(int(s[k, k]) - b * 255) <= 0.51 and v[k, k] == round(c * 255)


def flood(mask, starts, corners):
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    seen, todo = set(starts), list(starts)
    while todo:
        y, x = todo.pop()
        for dy, dx in near:
            p = (y + dy, x + dx)
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def plain_outlines(mask):
    """By flood fill: box, and area and arc from the squares between four neighbouring points of the filled component."""
    wide = np.pad(mask, 1)
    outside = flood(~wide, [(0, 0)], False)
    found, done = [], set()
    for y, x in zip(*np.nonzero(wide)):
        if (y, x) in done:
            continue
        own = flood(wide, [(y, x)], True)
        done |= own
        if (y, x - 1) not in outside:
            continue
        alone = np.zeros_like(wide)
        alone[tuple(np.array(sorted(own)).T)] = True
        filled = np.ones_like(wide)
        filled[tuple(np.array(sorted(flood(~alone, [(0, 0)], False))).T)] = False
        a, b, c, d = filled[:-1, :-1], filled[:-1, 1:], filled[1:, :-1], filled[1:, 1:]
        n = a.astype(int) + b + c + d
        across = ((a & d & ~b & ~c) | (b & c & ~a & ~d)).sum()
        area = (n == 4).sum() + 0.5 * (n == 3).sum()
        arc = math.sqrt(2) * ((n == 3).sum() + 2 * across) + ((n == 2).sum() - across)
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        found.append((min(xs) - 1, min(ys) - 1, max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, area, arc))
    return found


def test_outlines_equal_a_flood_fill():
    rng = np.random.default_rng(10)
    for density in (0.1, 0.3, 0.5, 0.6, 0.8, 0.95):
        for _ in range(25):
            mask = rng.random(rng.integers(1, 16, 2)) < density
            got, want = I.outlines(mask), plain_outlines(mask)
            assert [g[:4] for g in got] == [w[:4] for w in want]
            assert [g[4:] for g in got] == [pytest.approx(w[4:]) for w in want]
    assert I.outlines(np.zeros((4, 4), bool)) == []


def test_closing_equals_a_plain_loop():
    rng = np.random.default_rng(11)
    for widths in ([1, 1, 1], I.ellipse(5), [2]):
        mask = rng.random((14, 17)) < 0.12
        brush = [(k - len(widths) // 2, x) for k, w in enumerate(widths) for x in range(-w, w + 1)]
        inside = lambda y, x: 0 <= y < 14 and 0 <= x < 17
        grown = np.array([[any(inside(y + dy, x + dx) and mask[y + dy, x + dx] for dy, dx in brush) for x in range(17)] for y in range(14)])
        want = np.array([[all(not inside(y + dy, x + dx) or grown[y + dy, x + dx] for dy, dx in brush) for x in range(17)] for y in range(14)])
        assert (I.closed(mask, widths) == want).all()
    assert I.ellipse(9) == [0, 3, 3, 4, 4, 4, 3, 3, 0]


def test_marks_on_pages(spark):
    page = np.full((800, 600, 3), 250, np.uint8)
    y, x = np.mgrid[:800, :600]
    page[np.abs(np.hypot(y - 200, x - 300) - 45) < 4] = (30, 40, 170)  # a round stamp
    for k in range(150):  # a stroke, up and down
        page[700 + int(9 * math.sin(k / 5)) : 704 + int(9 * math.sin(k / 5)), 350 + k] = 20
    blank = np.full((50, 60, 3), 255, np.uint8)
    rows = [("p", "a", 0, 1, 600, 800, page.tobytes(), None, None), ("p", "b", 0, 1, 60, 50, blank.tobytes(), None, None), ("p", "c", 0, 1, None, None, None, None, "broken")]
    pages = spark.createDataFrame(rows, images.SCHEMA)
    found = {r.cls: r for r in imaging.found_marks(pages).collect()}
    assert set(found) == {"stamp", "signature"} and {r.doc_id for r in found.values()} == {"a#0"}
    s, w = found["stamp"], found["signature"]
    assert abs(s.x1 - 245) < 5 and abs(s.x2 - 356) < 5 and abs(s.y1 - 145) < 5 and abs(s.y2 - 256) < 5
    assert w.x1 <= 350 and w.x2 >= 500 and w.y1 <= 692 and w.y2 >= 712
    clean = imaging.preprocessed(spark.createDataFrame(rows[1:], images.SCHEMA)).collect()
    assert [(r.name, r.width, r.height, r.turned) for r in clean] == [("b", 60, 50, 0.0)]
    assert [(r.name, r.threshold) for r in imaging.levels(pages).collect() if r.name == "b"] == [("b", 0)]


def test_archives_stand_for_their_files(spark, tmp_path):
    """many scans lie in few packed archives; every page and fault of a loose folder comes from them, too."""
    pages = [np.full((40, 60, 3), shade, np.uint8) for shade in range(3)]
    files = {f"{k}.png": as_png(pages[k % 3]) for k in range(23)} | {"many.ppm": b"".join(map(as_anymap, pages)), "cut.png": as_png(pages[0])[:40], "a b.txt": b"none"}
    loose, packed = tmp_path / "loose", tmp_path / "packed"
    rows = spark.createDataFrame(list(files.items()), "name string, content binary").repartition(2, "name")
    assert write_files(rows, str(loose)) == write_archives(rows, str(packed), 5) == 26
    found = sorted(packed.iterdir())
    assert 6 <= len(found) <= 8 and sum(p.stat().st_size for p in found) < sum(map(len, files.values())) / 2
    keys = lambda df: sorted((r.name, r.page_index, r.page_count, r.width, r.pixels and bytes(r.pixels), r.error) for r in df.collect())
    expected = keys(page_images(spark, str(loose)))
    assert len(expected) == 28
    for size in (1 << 20, 700):  # whole archives, and every n-th file of each
        assert keys(page_images(spark, str(packed), size)) == expected
    assert keys(pages_of(spark.read.format("binaryFile").load(str(packed)))) == expected
    (packed / "broken.zip").write_bytes(found[0].read_bytes()[:100])
    assert [r.error for r in page_images(spark, str(packed)).where("name = 'broken.zip'").collect()] == ["File is not a zip file"]


def test_rows_that_repeat_are_undone_once(monkeypatch):
    """a page of blank paper costs a few rows, not all of them; the samples stay."""
    from docketry.sources import images

    done = []
    paeth = images._paeth
    monkeypatch.setattr(images, "_paeth", lambda row, up: (done.append(1), paeth(row, up)))
    page = np.full((200, 90, 3), 255, np.uint8)
    page[50:60, 20:40] = 7
    assert (png(as_png(page)) == page).all()
    assert len(done) <= 6  # of 40


def test_kernels_look_at_the_marks_only():
    """cropped to the mark, with what lies at the page's edge, closing and outlines are those of the whole page."""
    rng = np.random.default_rng(5)
    for k in range(40):
        mask = np.zeros((70, 90), bool)
        y, x = rng.integers(0, 60), rng.integers(0, 80)
        mask[y : y + 10, x : x + 12] = rng.random(mask[y : y + 10, x : x + 12].shape) < 0.5
        if k % 3 == 0:
            mask[0, 0] = mask[-1, -1] = True  # the mark's box is the page
            own = mask.copy()
            own[0, 0] = own[-1, -1] = False
            both = I.outlines(mask)
            assert [o for o in both if o[2] > 1 or o[3] > 1] == [o for o in I.outlines(own) if o[2] > 1 or o[3] > 1]
        brush = I.ellipse(9)
        wide = lambda m: np.array([[any(m[v, u] for v in range(max(0, j - 4), min(70, j + 5)) for u in range(max(0, i - brush[v - j + 4]), min(90, i + brush[v - j + 4] + 1))) for i in range(90)] for j in range(70)])
        if k < 3:
            assert (I.closed(mask, brush) == ~wide(~wide(mask))).all()
        rgb = rng.integers(0, 256, (30, 40, 3), dtype=np.uint8)
        h, s, v = I.hue(rgb)
        assert (I.stamp_ink(rgb) == ((v >= 30) & (v <= 220) & (((h >= 85) & (h <= 135) & (s >= 60)) | (((h <= 10) | (h >= 165)) & (s >= 70))))).all()
        grey = rng.integers(0, 256, (30, 40), dtype=np.uint8)
        at = np.nonzero(grey <= I.otsu(grey))
        assert I.skew(grey) == I.box_angle(np.stack(at[::-1], axis=1))
