"""WARC archives with revisit resolution.

``write_archives`` writes one response record a row, each a gzip member, one archive a task, and returns
the records' headers. ``resolve`` shuffles these headers by payload digest: of equal payloads the record
of the largest page id (then the last archive and offset) is the response, the others revisit it.
``rewrite`` goes through each archive with its resolved headers and writes a deduplicated archive:
responses get fresh headers over their payload, revisits a header alone. ``read_archives`` streams any of
these archives. Payloads are never shuffled. Names and bytes of an archive follow from its rows, and each
file is put in place by one rename, so a task that runs again writes the same archive.

A null html is an empty payload, and empty payloads are equal. A null page id sorts below all others; a
null url leaves its header out; line breaks and other controls in a url are percent-encoded. Repeated
rows are records of their own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import file_system, new_path, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{archive}#{offset}')}>"


def record(kind: str, own_id: str, page_id: int | None, url: str | None, digest: str, length: int, payload: bytes, original: tuple[str, int, str | None] | None = None) -> bytes:
    """One record as a gzip member. ``original``: record id, page id and url that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    clean = lambda u: _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", u or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean(url)}"] * (url is not None) + [f"Page-ID: {page_id}"] * (page_id is not None)
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if original:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original[0]}"]
        head += [f"WARC-Refers-To-Target-URI: {clean(original[2])}"] * (original[2] is not None) + [f"Refers-To-Page-ID: {original[1]}"] * (original[1] is not None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(headers, the payload's full length, payload) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield head, length, payload


@contextlib.contextmanager
def _archive(path: str):
    """A file that appears under ``path`` only when it is whole."""
    fs, target = file_system(path)
    part = f"{target}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, target)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; returns archive, at, size, page_id, url, digest and payload_bytes of each record."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next(batches, None)
        if first is None:
            return
        with _archive(f"{folder}/{name}") as out:
            at = 0
            for batch in (b for group in ([first], batches) for b in group):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    digest = digest_of(payload)
                    member = record("response", record_id(name, at), page, url, digest, len(payload), payload)
                    out.write(member)
                    rows.append((name, at, len(member), page, url, digest, len(payload)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["archive", "at", "size", "page_id", "url", "digest", "payload_bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(given.mapInArrow(run, "archive string, at long, size long, page_id long, url string, digest string, payload_bytes long"), "warc-headers")


def resolve(headers: DataFrame) -> DataFrame:
    """``headers`` with ``original``: a struct of the response's archive, at, page_id and url for a revisit, else null."""
    lead = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("rank"), "archive", "at", "page_id", "url")
    originals = headers.groupBy("digest", "payload_bytes").agg(F.max(lead).alias("lead"))
    joined = headers.join(originals, ["digest", "payload_bytes"])
    is_lead = (F.col("lead.archive") == F.col("archive")) & (F.col("lead.at") == F.col("at"))
    return joined.select(*headers.columns, F.when(~is_lead, F.struct("lead.archive", "lead.at", "lead.page_id", "lead.url")).alias("original"))


def rewrite(resolved: DataFrame, folder: str, target: str) -> DataFrame:
    """Write each archive of ``folder`` anew to ``target``; returns the archives' names and numbers of records."""
    fs, root = file_system(target)
    fs.create_dir(root, recursive=True)

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("at").to_pylist()
        name = rows[0]["archive"]
        source_fs, source = file_system(f"{folder}/{name}")
        at = 0
        with source_fs.open_input_file(source) as given, _archive(f"{target}/{name}") as out:
            for r in rows:
                payload, original = b"", None
                if r["original"] is None:
                    given.seek(r["at"])
                    _, _, payload = next(parse(io.BytesIO(zlib.decompress(given.read(r["size"]), 31))))
                else:
                    o = r["original"]
                    original = (record_id(o["archive"], o["at"]), o["page_id"], o["url"])
                member = record("revisit" if original else "response", record_id(name, r["at"]), r["page_id"], r["url"], r["digest"], r["payload_bytes"], payload, original)
                out.write(member)
                at += len(member)
        return pa.table({"archive": [name], "records": [len(rows)]})

    # headers are small and payloads are not, so as many tasks as there are archives
    archives = max(1, resolved.select("archive").distinct().count())
    return written(resolved.repartition(archives, "archive").groupBy("archive").applyInArrow(run, "archive string, records long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the named archives; responses are held against their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = file_system(f"{folder}/{name}")
                rows = []
                with fs.open_input_stream(path, compression="gzip") as stream:
                    for head, length, payload in parse(io.BufferedReader(stream, 1 << 20)):
                        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        if kind == "response" and digest_of(payload) != digest:
                            raise ValueError(f"{path}: payload of {head['warc-record-id']} does not have its digest")
                        number = lambda k, head=head: int(head[k]) if k in head else None
                        rows.append((head["warc-record-id"], number("page-id"), head.get("warc-target-uri"), kind, digest, length, number("refers-to-page-id"), payload.decode() if payloads and kind == "response" else None))
                        if len(rows) == 500:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    schema = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"
    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(run, schema)


def deduplicated_records(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, resolve the revisits, write the deduplicated archives and read them back."""
    spark = pages.sparkSession
    first, last = new_path(spark, "warc"), new_path(spark, "warc-deduplicated")
    headers = write_archives(pages, first)
    return read_archives(rewrite(resolve(headers), first, last), last)
