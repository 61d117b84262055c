"""Pages of PDF files: how many there are, their text layer, and the scan that fills a page.

Objects are found by their headers, so files without a sound cross-reference table are read too; object streams are
opened. The text layer is what the text operators show in one-byte codes. A page's picture is the largest image drawn
on it, with 1 or 8 bits a sample in grey or RGB, stored or deflated (with or without row filters). Pages without such an
image have no picture: drawings and fonts are not rendered. Encrypted files are a fault.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

from docketry.sources.images import MOST_PIXELS, BadImage, unfiltered

_OBJECT = re.compile(rb"(?:^|[\s>])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_WORD = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]+\s*)*(<<|>>|[\[\]]|/[^\s()<>\[\]{}/%]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ENDS = (b">>", b"]")
_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
DEEPEST = 64


class Ref(int):
    """A reference to an object by its number."""


def words(data: bytes, at: int = 0) -> Iterator[tuple[bytes, int]]:
    while m := _WORD.match(data, at):
        at = m.end()
        yield m[1], at


def text_of(word: bytes) -> bytes:
    """The bytes of a string."""
    if word.startswith(b"<"):
        digits = re.sub(rb"\s", b"", word[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else _SIGNS.get(m[1], m[1])
    return _ESCAPE.sub(plain, word[1:-1])


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value that begins at ``at``: a dict, list, name (str with a slash), string, number or reference; and its end."""
    if depth > DEEPEST:
        raise BadImage("values nested too deep")
    m = _WORD.match(data, at)
    if not m:
        raise BadImage("a value is missing")
    word, at = m[1], m.end()
    if word in (b"<<", b"["):
        items: list = []
        while True:
            m = _WORD.match(data, at)
            if not m:
                raise BadImage("an open dictionary or array")
            if m[1] in _ENDS:
                at = m.end()
                break
            item, at = value(data, at, depth + 1)
            if item == "R" and len(items) > 1 and isinstance(items[-2], int):
                items[-2:] = [Ref(items[-2])]
            else:
                items.append(item)
        return (dict(zip(items[::2], items[1::2])) if word == b"<<" else items), at
    if word[:1] == b"/":
        return word.decode("latin-1"), at
    if word[:1] in (b"(", b"<"):
        return text_of(word), at
    try:
        return (int(word) if re.fullmatch(rb"[+-]?\d+", word) else float(word)), at
    except ValueError:
        return word.decode("latin-1"), at


class File:
    """The objects of a file by number; a later one of a number takes the place of an earlier."""

    def __init__(self, data: bytes):
        self.data, self.at, self.packed = data, {}, {}
        for m in _OBJECT.finditer(data):
            self.at[int(m[1])] = m.end()
        for number in list(self.at):
            if b"/ObjStm" in data[self.at[number] : self.at[number] + 512]:
                self._unpack(number)
        if not self.at:
            raise BadImage("no objects")

    def _unpack(self, number: int) -> None:
        head, body = self.stream(number)
        n, first = head.get("/N", 0), head.get("/First", 0)
        numbers = [int(w) for w, _ in words(body[:first])][: 2 * n]
        for own, offset in zip(numbers[::2], numbers[1::2]):
            self.packed[own] = body[first + offset :]

    def get(self, item: object, depth: int = 0) -> object:
        """``item``, or what it refers to."""
        if not isinstance(item, Ref):
            return item
        if depth > DEEPEST:
            raise BadImage("references in a circle")
        if int(item) in self.at:
            found = value(self.data, self.at[int(item)])[0]
        elif int(item) in self.packed:
            found = value(self.packed[int(item)], 0)[0]
        else:
            return None
        return self.get(found, depth + 1)

    def stream(self, number: int) -> tuple[dict, bytes]:
        """An object's dictionary and its bytes, decoded."""
        if number not in self.at:
            raise BadImage("a stream is missing")
        head, at = value(self.data, self.at[number])
        m = re.compile(rb"\s*stream\r?\n").match(self.data, at)
        if not m or not isinstance(head, dict):
            raise BadImage("an object is no stream")
        size = self.get(head.get("/Length"))
        end = m.end() + size if isinstance(size, int) and self.data[m.end() + size : m.end() + size + 12].lstrip().startswith(b"endstream") else self.data.find(b"endstream", m.end())
        body = self.data[m.end() : end if end >= 0 else len(self.data)]
        filters = self.get(head.get("/Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            name = self.get(name)
            if name in ("/FlateDecode", "/Fl"):
                body = zlib.decompressobj().decompress(body, 4 * MOST_PIXELS)
            elif name in ("/ASCIIHexDecode", "/AHx"):
                body = text_of(b"<" + body.split(b">")[0] + b">")
            else:
                raise BadImage(f"no decoder for {name}")
        return head, body

    def pages(self) -> list[dict]:
        """Each page's dictionary, with what it inherits."""
        roots = [found for n in (*self.at, *self.packed) if isinstance(found := self.get(Ref(n)), dict) and found.get("/Type") == "/Catalog"]
        if not roots:
            raise BadImage("no catalog")
        found: list[dict] = []
        todo, seen = [(roots[-1].get("/Pages"), {})], set()
        while todo:
            item, given = todo.pop()
            node = self.get(item)
            if not isinstance(node, dict) or (isinstance(item, Ref) and item in seen):
                continue
            seen.add(item if isinstance(item, Ref) else None)
            given = given | {k: node[k] for k in ("/Resources", "/MediaBox") if k in node}
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                todo += [(k, given) for k in reversed(kids)]
            else:
                found.append(given | node)
        return found

    def text(self, page: dict) -> str:
        """What the page's text operators show, a line for each move to another line."""
        contents = self.get(page.get("/Contents"))
        parts = contents if isinstance(contents, list) else [page.get("/Contents")] if page.get("/Contents") is not None else []
        body = b"\n".join(self.stream(int(p))[1] for p in parts if isinstance(p, Ref))
        out, held = [], []
        for word, _ in words(body):
            if word[:1] in (b"(", b"<") and word != b"<<":
                held.append(text_of(word))
            elif word in (b"Tj", b"TJ", b"'", b'"'):
                out += [b"\n"] * (word in (b"'", b'"')) + held
                held = []
            elif word in (b"Td", b"TD", b"T*", b"ET", b"Tm"):
                out.append(b"\n")
                held = []
        lines = b"".join(out).decode("cp1252", "replace").split("\n")
        return "\n".join(line for line in (" ".join(line.split()) for line in lines) if line)

    def picture(self, page: dict) -> np.ndarray | None:
        """RGB of the largest image of the page's resources."""
        resources = self.get(page.get("/Resources")) or {}
        drawn = self.get(resources.get("/XObject")) if isinstance(resources, dict) else None
        images = [(self.get(r), r) for r in (drawn or {}).values() if isinstance(r, Ref)] if isinstance(drawn, dict) else []
        sized = [(self.get(h.get("/Width")) * self.get(h.get("/Height")), int(r)) for h, r in images if isinstance(h, dict) and h.get("/Subtype") == "/Image" and isinstance(self.get(h.get("/Width")), int) and isinstance(self.get(h.get("/Height")), int)]
        if not sized:
            return None
        head, body = self.stream(max(sized)[1])
        width, height, bits = (self.get(head.get(k, 8)) for k in ("/Width", "/Height", "/BitsPerComponent"))
        channels = {"/DeviceGray": 1, "/DeviceRGB": 3}.get(self.get(head.get("/ColorSpace", "/DeviceGray")))
        if channels is None or bits not in (1, 8) or not 0 < width * height <= MOST_PIXELS or min(width, height) < 1:
            raise BadImage("an image of another kind")
        line = (width * channels * bits + 7) // 8
        parms = self.get(head.get("/DecodeParms")) or {}
        filtered = isinstance(parms, dict) and (self.get(parms.get("/Predictor")) or 1) >= 10
        if len(body) < height * (line + filtered):
            raise BadImage("too few bytes of pixels")
        rows = np.frombuffer(body, np.uint8, height * (line + filtered)).reshape(height, line + filtered)
        rows = unfiltered(rows[:, 1:], rows[:, 0], max(1, channels * bits // 8)) if filtered else rows
        if bits == 1:
            rows = np.unpackbits(rows, axis=1)[:, : width * channels] * np.uint8(255)
        found = rows.reshape(height, width, channels)
        return np.repeat(found, 3, axis=2) if channels == 1 else found


def read(data: bytes) -> list[tuple[str | None, np.ndarray | None, str | None]]:
    """(text layer, RGB, error) of each page."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise BadImage("an encrypted file")
    file = File(data)
    found = []
    for page in file.pages():
        try:
            found.append((file.text(page) or None, file.picture(page), None))
        except (BadImage, zlib.error, ValueError, TypeError, AttributeError, RecursionError) as fault:
            found.append((None, None, str(fault)))
    if not found:
        raise BadImage("no pages")
    return found


def write(pages: list[tuple[str, np.ndarray | None]]) -> bytes:
    """A file of pages of a text layer and an image, deflated."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    stream = lambda head, body: b"<< " + head + b" /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed := zlib.compress(body)) + packed + b"\nendstream"
    kids = []
    for text, image in pages:
        escaped = [re.sub(rb"([()\\])", rb"\\\1", line.encode("cp1252", "replace")) for line in text.split("\n")]
        objects.append(stream(b"", b"BT /F1 12 Tf 72 700 Td " + b" ".join(b"(" + line + b") Tj T*" for line in escaped) + b" ET"))
        own = b"/Contents %d 0 R" % len(objects)
        if image is not None:
            objects.append(stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /DeviceRGB" % (image.shape[1], image.shape[0]), image.tobytes()))
            own += b" /Resources << /XObject << /Im0 %d 0 R >> >>" % len(objects)
        objects.append(b"<< /Type /Page /Parent 2 0 R " + own + b" >>")
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] >>" % (len(kids), b" ".join(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n" % (k + 1) + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, at))
