"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, attempt_name, file_system, join_repeated, new_folder, read

ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or f"urn:page:{page_id}" if c not in "\r\n")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a .warc.gz stream.

    The stream is read READ_BYTES at a time and decompressed as it comes; memory holds one
    record. A record must fill its gzip member exactly, and its block must have the stated
    length and digest.
    """
    rest, done = b"", False
    while True:
        member, data = zlib.decompressobj(31), bytearray()
        length = start = None
        while not member.eof:
            if not rest and not done:
                rest = stream.read(READ_BYTES)
                done = not rest
            if not rest:
                break
            data += member.decompress(rest)
            rest = member.unused_data
            if length is None and (end := data.find(b"\r\n\r\n")) >= 0:
                version, *lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError("not a WARC record")
                fields = dict(line.split(": ", 1) for line in lines)
                length, start = int(fields["Content-Length"]), end + 4
        if not member.eof:
            if data or length is not None:
                raise ValueError("the archive ends inside a record")
            return
        if length is None or len(data) != start + length + 4 or data[-4:] != b"\r\n\r\n":
            raise ValueError("the record does not fill its gzip member")
        block = bytes(data[start : start + length])
        if fields.get("WARC-Block-Digest", "") not in ("", f"sha1:{digest_of(block)}"):
            raise ValueError(f"block digest of {fields.get('WARC-Record-ID')} does not match")
        yield fields, block


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload bytes, digest, type, refers_to of a record, checking a response's payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(http["Content-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-ID"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID")


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Add `_first`: the smallest page_id of rows with the same payload, null if there is no other row."""
    keyed = pages.withColumn("_digest", F.unhex(F.sha2("_payload", 256)))
    groups = Scratch(pages.sparkSession).keep(
        keyed.groupBy("_digest").agg(
            F.min("page_id").alias("_first"), F.count("*").alias("_n"), F.first(F.octet_length("_payload")).alias("_size")
        ),
        "warc-digests",
    )
    repeated = groups.where((F.col("_n") > 1) & (F.col("_size") >= min_bytes)).select("_digest", "_first", "_n")
    own = F.concat_ws("~", F.col("page_id").cast("string"), F.col("url"))
    return join_repeated(keyed, repeated, "_digest", "_n", own).select("page_id", "url", "_payload", "_first")


MANIFEST = "path string, n_records long, n_bytes long"
MANIFEST_ARROW = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row into .warc.gz files of about ARCHIVE_BYTES; returns the manifest of finished files.

    Of rows with equal payloads of at least `min_bytes` the one with the smallest page_id is
    the response, the others revisit it. Files of failed attempts are not in the manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("_payload")
    decided = with_first(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload), min_bytes)

    def run(batches):
        fs, place = file_system(folder)
        out, name, count, size = None, "", 0, 0

        def finish():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": count, "n_bytes": size}], schema=MANIFEST_ARROW)

        for batch in batches:
            ids, urls, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "_first"))
            for page_id, url, payload, first in zip(ids, urls, batch.column("_payload"), firsts):
                if out is None:
                    name, count, size = attempt_name("pages", ".warc.gz"), 0, 0
                    out = fs.open_output_stream(f"{place}/{name}", compression=None)
                data = payload.as_py()
                member = gzip_member(record(page_id, url, data, digest_of(data), first, first is not None and page_id != first))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return Scratch(spark).keep(decided.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives named in `path`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every archive is read by one task from front to back.
    """
    files = manifest.select("path").repartition(max(1, min(manifest.count(), 4096)))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])))

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = file_system(path)
                rows = []
                with fs.open_input_stream(place, compression=None) as stream:
                    for fields, block in records(stream):
                        rows.append(page_of(fields, block))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive all pages and read the archives back; one row per page.

    Null html is the empty payload, which is shared like any other; a null url becomes
    urn:page:<id>; a null page_id comes last, so such rows revisit a named page with their
    payload and are responses where there is none; rows with one id and payload are all what
    the first of them is. An empty table gives no archive and no rows. Other columns are not read.
    """
    return read_archives(write_archives(pages, min_bytes))


def op6_gzip_member_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages"))
