"""WARC archives: a writer with revisit records and a reader that splits compressed files.

Every record is a gzip member of its own. A reading task owns a byte range of one archive: it looks
for the gzip magic, takes a place as a member only if its first bytes inflate to a WARC version
line, and reads the records whose members start inside its range, the last one to its end wherever
that lies. So one archive is read by many tasks, and no index is needed.

Archives are opened through ``pyarrow.fs``, by URI; the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.arrays import small_batches
from trafficlens.session import written

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 8 << 20
TASK_BYTES = 256 << 20  # of archives that a task reads, about
CHUNK = 1 << 18
WRITTEN = "path string, bytes bigint, records bigint"
RECORDS = (
    "id bigint, url string, record_type string, payload binary, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, record_id string, refers_to_id string"
)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if urlparse(uri).scheme:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _header(fields: dict[str, object]) -> bytes:
    clean = lambda v: re.sub(r"[\r\n]+", " ", str(v))
    return VERSION + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: the whole payload, or a revisit that names its response."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = _header({
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if key is None else key}>",
        "WARC-Target-URI": url,
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    })
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows (id, url, payload, payload_digest, refers_to) as archives, one per task.

    Returns rows (path, bytes, records) of the archives; evaluating it writes them. A task that runs
    again writes a file under another name, and only the files it names count: give the rows, not
    the folder, to the reader. Null ids and addresses are written as empty, a null payload as no bytes;
    repeated rows give a record each; a task without rows writes no archive.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        out = path = None
        records = 0
        for batch in batches:
            if batch.num_rows and out is None:
                system.create_dir(base, recursive=True)
                name = f"pages-{uuid.uuid4().hex}.warc.gz"
                out, path = system.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None), f"{folder.rstrip('/')}/{name}"
            for at in range(batch.num_rows):
                key, url, payload, digest, refers = (batch.column(k)[at].as_py() for k in range(5))
                out.write(record_bytes(key, url, payload, digest, refers))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())],
                names=["path", "bytes", "records"])

    small_batches(pages.sparkSession)
    return pages.select("id", "url", "payload", "payload_digest", "refers_to").mapInArrow(write, WRITTEN)


def _page(value: str | None) -> int | None:
    """The page of a record id that ``record_bytes`` wrote; null for ids of other writers."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


def _matches(data: bytes, declared: str) -> bool:
    """Whether data has a digest "algorithm:value", in hex or base32; true for unknown algorithms."""
    name, _, value = declared.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(name, data)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def parse_record(raw: bytes) -> tuple:
    """The columns of RECORDS from a record, of any type.

    The payload is the body of an HTTP message, else the whole block. Digests are checked where a
    record has them, that of the payload not if it is truncated or in a transfer encoding. A record
    without a type raises ValueError.
    """
    head, _, block = raw.partition(b"\r\n\r\n")
    unfolded = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in unfolded.split("\r\n")[1:])}
    if "warc-type" not in fields:
        raise ValueError("a record without WARC-Type")
    kind, key = fields["warc-type"].lower(), fields.get("warc-record-id")
    message = fields.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if message else (b"", b"", block)
    declared = fields.get("warc-payload-digest")
    whole = "warc-truncated" not in fields
    if whole and "warc-block-digest" in fields and not _matches(block, fields["warc-block-digest"]):
        raise ValueError(f"block of {key} does not match its digest")
    if kind == "revisit":
        payload = None
        found = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
        size = int(found[1]) if found else None
        digest = declared.removeprefix("sha256:") if declared else None
    else:
        coded = re.search(rb"(?im)^Transfer-Encoding:", http)
        if declared and whole and not coded and not _matches(payload, declared):
            raise ValueError(f"payload of {key} does not match its digest")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    refers = fields.get("warc-refers-to")
    return _page(key), fields.get("warc-target-uri"), kind, payload, size, digest, _page(refers), key, refers


def _is_member(file, at: int) -> bool:
    """Whether a gzip member with a WARC record begins here: its header must decode."""
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(4096), len(VERSION)).startswith(b"WARC/1.")
    except zlib.error:
        return False


def record_size(data: bytearray) -> int | None:
    """Bytes of the record that data begins with, None as long as its header is not all there."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    if not data.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {bytes(data[:20])!r}")
    length = re.search(rb"(?im)^content-length[ \t]*:[ \t]*(\d+)[ \t]*\r?$", data[:end])
    if not length:
        raise ValueError("a record without Content-Length")
    return end + 4 + int(length[1])


def records_in_range(file, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The records of the gzip members that start in [start, stop), with the member's place.

    A member may hold any number of records, as that of an archive gzipped as a whole does. It is
    inflated piece by piece, so that memory is bounded by the largest record.
    """
    at = start
    while at < stop:
        file.seek(at)
        # Two bytes more, for a magic that begins just before the end.
        window = file.read(min(CHUNK, stop - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(len(window) - len(MAGIC) + 1, 1)
            continue
        at += found
        if at >= stop:
            return
        if not _is_member(file, at):
            at += 1
            continue
        member, unpacker, data = at, zlib.decompressobj(31), bytearray()
        file.seek(at)
        while not unpacker.eof:
            chunk = file.read(CHUNK)
            if not chunk:
                raise ValueError(f"a record at byte {member} is cut off")
            at += len(chunk)
            while chunk:
                data += unpacker.decompress(chunk, 4 * CHUNK)
                chunk = unpacker.unconsumed_tail
                done = 0
                while True:
                    # Records end with two line breaks, which are no part of them.
                    while data[done : done + 2] == b"\r\n":
                        done += 2
                    rest = data[done:] if done else data
                    length = record_size(rest) if rest else None
                    if length is None or len(rest) < length:
                        break
                    yield member, bytes(rest[:length])
                    done += length
                del data[:done]
        if data.strip(b"\r\n"):
            raise ValueError(f"the last record of the member at byte {member} is cut off")
        at -= len(unpacker.unused_data)


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of archives given as rows (path, bytes): columns of RECORDS.

    Each row is one record of any type. ``id`` and ``refers_to`` are pages and null for ids of other
    writers, ``record_id`` and ``refers_to_id`` the ids as they stand; ``payload_digest`` is a SHA-256 in
    hex, or for revisits what they declare. ``payload`` is null for revisits, and always with ``with_payload=False``.

    A member may hold several records, each gives a row; records that occur twice give two. Bytes
    between members are passed over; a record that is cut off, has no type or length, or does not match
    its digest stops the job, and the error names the archive and the byte. An archive of 0 bytes, or
    with a null path or size, has no records; no archives give no rows. Other columns are not read.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def located(path, records):
            try:
                yield from records
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error

        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def packed(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, inner = file_system(path)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for member, raw in located(path, records_in_range(file, start, min(size, start + split_bytes), size)):
                        try:
                            row = parse_record(raw)
                        except ValueError as error:
                            raise ValueError(f"{path}, member at byte {member}: {error}") from error
                        if not with_payload:
                            row = (*row[:3], None, *row[4:])
                        rows.append(row)
                        held += len(raw) if with_payload else 500
                        if held > 16 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    splits = archives.select(
        "path", "bytes",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))).alias("start"),
    ).where("bytes > 0 and path is not null")
    # A split is a few bytes here, but many in the archive: tasks are counted by those, some for each
    # core at least.
    found = splits.agg(F.count("*").alias("n"), F.sum(F.least(F.lit(split_bytes), F.col("bytes") - F.col("start"))).alias("bytes")).first()
    tasks = max(-(-(found.bytes or 0) // TASK_BYTES), 2 * archives.sparkSession.sparkContext.defaultParallelism)
    return splits.repartition(max(1, min(found.n, tasks))).mapInArrow(read, RECORDS)


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, bytes) of the archives in a folder that somebody else wrote; none if there is no folder."""
    system, base = file_system(folder)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    rows = [(f"{folder.rstrip('/')}/{f.base_name}", f.size) for f in found if f.base_name.endswith(".warc.gz")]
    return spark.createDataFrame(rows, "path string, bytes bigint")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows for ``write_warc``: payload, digest, and the page that holds the same payload.

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest id is the
    response. Rows that share that id, too, are all responses; a null id never is one that others
    refer to. A null payload is empty. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    size = F.octet_length("payload")
    # Only digests travel; a payload that a third of all pages share adds up before the shuffle.
    firsts = written(
        rows.where(size >= min_bytes).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("payload_digest", "first"), "warc-firsts")
    joined = rows.join(firsts, "payload_digest", "left")
    refers = F.when((size >= min_bytes) & (F.col("first") < F.col("id")), F.col("first"))
    return joined.select("id", "url", "payload", "payload_digest", refers.alias("refers_to"))
