"""Legacy ARC archives to WARC, and both ways of reading and writing them.

An ARC file names its version and its header fields in its first record. The
converter reads each record by its declared length, then synthesises what ARC
lacks: record ids, ISO timestamps, types and digests. Payloads stay in files
that tasks stream one record at a time; only narrow rows (archive, place,
digest) are shuffled to find equal payloads, and come back to the archive's
task as a list no longer than the archive.

Every attempt writes files of its own names and reports them in its rows; Spark
commits those rows once, so a lost executor leaves files that nobody reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickettide.llm.common import text_bytes, work_path, written

#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 0
#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
_CRAWLED = "20240101000000"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_file(uri: str, mode: str):
    """A file of any store that Arrow knows, buffered."""
    system, path = pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri))
    if mode == "rb":
        return io.BufferedReader(system.open_input_file(path), 1 << 20)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


# ARC


def arc_head(name: str, version: int) -> bytes:
    body = f"{version} 0 tickettide\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    between = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {_CRAWLED} text/plain{between} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str, offset: int) -> bytes:
    between = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {mime}{between} {len(block)}\n".encode() + block + b"\n"


class ArcError(ValueError):
    """An archive that breaks the format."""


def read_arc(stream) -> Iterator[dict]:
    """Records of an ARC file: the header's fields by name, and the block.

    The first record gives the version and the fields; later header lines are
    cut from the right, as URLs may hold blanks. Blank lines between records
    are skipped. A header without its fields, a length that is no number or
    reaches beyond the file, is an ArcError that names the place.
    """
    fields, place = None, 0
    while True:
        line = stream.readline()
        if not line:
            return
        start, place = place, place + len(line)
        if not line.strip():
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if fields is None:
            if not text.startswith("filedesc://"):
                raise ArcError(f"no version record at byte {start}")
            length = _number(text.rpartition(" ")[2], start)
            block = _exactly(stream, length, start)
            lines = block.decode("utf-8", "replace").splitlines()
            if len(lines) < 2 or not lines[0].split()[:1] or lines[0].split()[0] not in ("1", "2"):
                raise ArcError(f"unknown version at byte {start}")
            fields = lines[1].split()
            if fields[:1] != ["URL"] or fields[-1:] != ["Archive-length"]:
                raise ArcError(f"unknown header fields at byte {start}")
            place += length
            kind = ARC_FIELDS[int(lines[0].split()[0])]
            values = text.rsplit(" ", len(kind) - 1)
            yield {"URL": values[0], "Archive-date": values[2] if len(values) > 2 else _CRAWLED, "block": block, "offset": start}
            continue
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) < len(fields):
            raise ArcError(f"short header line at byte {start}")
        record = dict(zip(fields, values))
        length = _number(record["Archive-length"], start)
        record["block"], record["offset"] = _exactly(stream, length, start), start
        place += length
        yield record


def _number(text: str, place: int) -> int:
    if not text.isdigit():
        raise ArcError(f"no length at byte {place}")
    return int(text)


def _exactly(stream, length: int, place: int) -> bytes:
    block = stream.read(length)
    if len(block) < length:
        raise ArcError(f"record at byte {place} ends early")
    return block


# WARC


def iso_date(digits: str) -> str:
    """An ARC date of 14 digits, or a leading part of them, in ISO form."""
    whole = (digits + "00000101000000"[len(digits) :])[:14] if digits.isdigit() and len(digits) >= 4 else _CRAWLED
    return f"{whole[:4]}-{whole[4:6]}-{whole[6:8]}T{whole[8:10]}:{whole[10:12]}:{whole[12:14]}Z"


def payload_of(url: str, block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head, payload); what is no HTTP is all payload."""
    if url.lower().startswith(("http://", "https://")) and block.startswith(b"HTTP/"):
        head, gap, rest = block.partition(b"\r\n\r\n")
        if gap:
            return head + gap, rest
    return b"", block


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, ' '.join(str(p) for p in parts))}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def to_warc(record: dict, archive: str, original: dict | None = None) -> bytes:
    """A WARC record for an ARC record; a revisit of `original` (id, url, date) if there is one."""
    url, block, date = record["URL"], record["block"], iso_date(record["Archive-date"])
    own = record_id(archive, record["offset"])
    if url.startswith("filedesc://"):
        info = f"software: tickettide\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", own),
                            ("Content-Type", "application/warc-fields")], info)
    head, payload = payload_of(url, block)
    kind = "revisit" if original else "response" if head else "resource"
    headers = [("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", own),
               ("WARC-IP-Address", record.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if original:
        block = head
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original["id"]),
                    ("WARC-Refers-To-Target-URI", original["url"]), ("WARC-Refers-To-Date", original["date"])]
    headers.append(("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"))
    headers.append(("Content-Type", "application/http; msgtype=response" if head else record.get("Content-type", "application/octet-stream")))
    return warc_record(headers, block)


def read_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, block) of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, _exactly(stream, int(headers["content-length"]), -1)


# On Spark


def _http_block(page_id, payload: bytes) -> bytes:
    own = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb": *([^\r\n]*)", head)
    return found[1].decode() if found else None


class _Members:
    """A gzip file with a member per record."""

    def __init__(self, uri: str):
        self.uri, self.file, self.size, self.records = uri, open_file(uri, "wb"), 0, 0

    def add(self, data: bytes) -> None:
        self.file.write(gzip.compress(data, 4, mtime=0))
        self.size += len(data)
        self.records += 1


def write_arc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as ARC files of both versions: (archive, records), written once.

    A null html is an empty payload, a null url `about:blank`; blanks and
    control signs in a url are percent-encoded. Without pages there are no files.
    """

    def run(stream):
        made, current = [], None
        for batch in stream:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None:
                    version = 1 + len(made) % 2
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    current = _Members(f"{folder}/{name}")
                    current.add(arc_head(name, version))
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
                if not url.lower().startswith(("http://", "https://")):
                    url = f"http://unknown.invalid/{url}"
                current.add(arc_record(version, url, _CRAWLED, "text/html", _http_block(page_id, html), name, current.size))
                if current.size >= archive_bytes:
                    current.file.close()
                    made, current = [*made, current], None
        if current is not None:
            current.file.close()
            made.append(current)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.uri for m in made], pa.string()), pa.array([m.records for m in made], pa.int64())], ["archive", "records"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))
    return written(rows.mapInArrow(run, "archive string, records long"), "arc-files")


def _each_archive(archives: DataFrame, function, schema: str) -> DataFrame:
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(parts, "archive").mapInArrow(function, schema)


def scan_arc(archives: DataFrame) -> DataFrame:
    """(archive, offset, page_id, url, date, record, bytes, digest): the records of ARC files, without payloads."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["archive", "offset", "page_id", "url", "date", "record", "bytes", "digest"]

    def run(stream):
        for batch in stream:
            for archive in batch.column(0).to_pylist():
                rows = []
                with gzip.open(open_file(archive, "rb")) as file:
                    for record in read_arc(file):
                        if record["URL"].startswith("filedesc://"):
                            continue
                        head, payload = payload_of(record["URL"], record["block"])
                        own = _header(head, ID_HEADER)
                        rows.append((archive, record["offset"], None if own is None else int(own), record["URL"], iso_date(record["Archive-date"]),
                                     record_id(archive.rpartition("/")[2], record["offset"]), len(payload), sha1_base32(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return _each_archive(archives.select("archive"), run,
                         "archive string, offset long, page_id long, url string, date string, record string, bytes long, digest string")


def convert(archives: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """ARC files to WARC files: (archive, records), written once; one WARC file per ARC file.

    Of equal payloads (SHA-1 and length) of at least `least_payload` bytes the
    record with the smallest page_id (ties: archive, place; no id: last) is a
    response, the others revisit it.
    """
    records = written(scan_arc(archives), "arc-records")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset", "record", "url", "date")
    first = records.where(F.col("bytes") >= least_payload).groupBy("digest", "bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = records.join(first, ["digest", "bytes"]).where(F.col("record") != F.col("first.record")).groupBy("archive").agg(
        F.collect_list(F.struct("offset", F.col("first.record").alias("id"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("revisits"))

    def run(stream):
        made = []
        for batch in stream:
            for archive, own in zip(*(c.to_pylist() for c in batch.columns)):
                originals = {r["offset"]: r for r in own or []}
                name = archive.rpartition("/")[2]
                out = _Members(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                with gzip.open(open_file(archive, "rb")) as file:
                    for record in read_arc(file):
                        out.add(to_warc(record, name, originals.get(record["offset"])))
                out.file.close()
                made.append(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.uri for m in made], pa.string()), pa.array([m.records for m in made], pa.int64())], ["archive", "records"])

    # Written first: dealt out by the key of a join, its rows would keep that join's few partitions.
    jobs = written(archives.select("archive").join(revisits, "archive", "left").select("archive", "revisits"), "arc-jobs")
    return written(_each_archive(jobs, run, "archive string, records long"), "warc-files")


def scan_warc(archives: DataFrame) -> DataFrame:
    """(page_id, url, record, refers, record_type, payload_bytes, payload_digest) of the WARC records with a payload.

    A response's length and digest come from its payload, which must agree with
    its header; a revisit's from what it says of the payload it repeats.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "url", "record", "refers", "record_type", "payload_bytes", "payload_digest"]

    def run(stream):
        for batch in stream:
            for archive in batch.column(0).to_pylist():
                rows = []
                with gzip.open(open_file(archive, "rb")) as file:
                    for headers, block in read_warc(file):
                        kind, url = headers["warc-type"], headers.get("warc-target-uri", "")
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        head, payload = payload_of(url, block)
                        stated = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "revisit":
                            size = int(_header(head, "Content-Length") or 0)
                        else:
                            size = len(payload)
                            if sha1_base32(payload) != stated:
                                raise ValueError(f"{headers['warc-record-id']} in {archive}: payload and digest differ")
                        own = _header(head, ID_HEADER)
                        rows.append((None if own is None else int(own), url, headers["warc-record-id"], headers.get("warc-refers-to"), kind, size, stated))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return _each_archive(archives.select("archive"), run,
                         "page_id long, url string, record string, refers string, record_type string, payload_bytes long, payload_digest string")


def archive_round_trip(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages archived, converted and read back.

    One row per page, repeated rows included. `refers_to` is the page_id of the
    response a revisit repeats, null where that page has no id.
    """
    spark = pages.sparkSession
    arcs = write_arc(pages, work_path(spark, "arc"))
    warcs = convert(arcs, work_path(spark, "warc"), least_payload)
    rows = written(scan_warc(warcs), "warc-records")
    responses = rows.where("record_type <> 'revisit'").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"))
    return rows.join(responses, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
