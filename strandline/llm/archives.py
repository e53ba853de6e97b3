"""Converter of legacy ARC archives to WARC, with a writer for the first and a reader for the second.

An ARC file is a version block and records; the block's second line says which header line its records carry: version 1
has URL, IP, date, type and length, version 2 also result code, checksum, location, offset and file name. The declared
length alone delimits a record. The converter makes for each a WARC record: an identifier derived from file and place,
the date in WARC form, the type (response, or revisit of an equal payload), payload and block digests.

Payloads never leave the task that reads their file. A first pass lists digests (one narrow row a record); the first
holder of each digest comes from a grouped minimum with a map-side combine; the second pass reads each file once more
and writes its WARC file. Files are written under a temporary name and renamed, and a repeated task writes the same.

Nulls: a null text is an empty payload, a null URL is ``urn:page:`` and the id, a null id is carried as such and sorts
after all others as a holder. Repeated rows become records of their own: the one of smallest id, then file and place, is the
response. Empty tables give no files. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

# Fixed values of the two formats.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100  # bytes; records with a smaller payload are never revisits
CAPTURED = "20240101000000"
LEVEL = 1  # of compression

FILES = "file_no long, path string, n_records long"
PLACES = "file_no long, record_no long, page_id long, payload_bytes long, digest string"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def member(data: bytes) -> bytes:
    """One record as a gzip member of its own, the same bytes at every attempt."""
    return gzip.compress(data, LEVEL, mtime=0)


def arc_opening(name: str, version: str) -> bytes:
    body = f"{version} 0 Strandline\n{ARC_FIELDS[version]}\n"
    head = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain"
    head += f" {len(body)}" if version == "1" else f" 200 - - 0 {name} {len(body)}"
    return f"{head}\n{body}\n".encode()


def arc_record(version: str, name: str, place: int, url: str, block: bytes) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"{url} 192.0.2.1 {CAPTURED} text/html"
    head += f" {len(block)}" if version == "1" else f" 200 {hashlib.md5(block).hexdigest()} - {place} {name} {len(block)}"
    return f"{head}\n".encode() + block + b"\n"


def read_arc(source: BinaryIO) -> Iterator[ArcRecord]:
    """The records of one ARC stream, whichever of the versions its block declares."""
    head = source.readline().rstrip(b"\n")
    if not head.startswith(b"filedesc://"):
        raise ValueError("no ARC version block")
    body = source.read(int(head.rsplit(b" ", 1)[1])).decode()
    version = body.split(" ", 1)[0]
    fields = body.split("\n")[1].split(" ")
    if fields != ARC_FIELDS.get(version, "").split(" "):
        raise ValueError(f"unknown ARC header of version {version}")
    while line := source.readline():
        if not (line := line.rstrip(b"\n")):
            continue
        values = dict(zip(fields, line.decode().split(" "), strict=True))
        length = int(values["Archive-length"])
        block = source.read(length)
        if len(block) != length:
            raise ValueError("an ARC record ends before its declared length")
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], block)


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head as it stands, its fields by lower-case name, and the payload."""
    head, end, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + end, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file_no: int, record_no: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file_no}/{record_no}')}>"


def warc_record(arc: ArcRecord, own_id: str, first: tuple[int | None, str] | None) -> bytes:
    """``first``: page id and record id of the response that this record revisits."""
    head, _, payload = http_parts(arc.block)
    block = head if first else arc.block
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {own_id}",
        f"WARC-Date: {warc_date(arc.date)}", f"WARC-Target-URI: {arc.url}", f"WARC-IP-Address: {arc.ip}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if first:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {first[1]}", f"X-Refers-To-Page: {first[0]}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields by lower-case name and block of each record."""
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, source.read(int(fields["content-length"]))


def opened(uri: str) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=common.input_file(uri)), 1 << 20)


def write_arc(df: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """One ARC file a partition, of both versions in turn; the list of files comes back."""
    folder = common.shared_folder(df.sparkSession, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, places = TaskContext.get().partitionId(), 0
        version, name = str(number % 2 + 1), f"{number:06d}.arc.gz"
        system, base = common.open_folder(folder)
        draft = common.attempt_name(f"{base}/{name}")
        with system.open_output_stream(draft, compression=None) as sink:
            sink.write(member(arc_opening(name, version)))
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                    head += f"X-Page: {'' if page_id is None else page_id}\r\n\r\n"
                    url = f"urn:page:{page_id}" if url is None else url
                    sink.write(member(arc_record(version, name, places, url, head.encode() + payload)))
                    places += 1
        if places:
            common.finish(system, draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"file_no": number, "path": f"{folder}/{name}", "n_records": places}])
        else:
            system.delete_file(draft)

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(text_col).alias("html"))
    return common.stored(rows.mapInArrow(write, FILES), "arc-files")


def list_records(arc_files: DataFrame) -> DataFrame:
    """Place, page, payload size and payload digest of every record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            found = {k: [] for k in ("file_no", "record_no", "page_id", "payload_bytes", "digest")}
            with opened(row["path"]) as source:
                for n, record in enumerate(read_arc(source)):
                    _, fields, payload = http_parts(record.block)
                    page = int(fields["x-page"]) if fields["x-page"] else None
                    for k, v in zip(found, (row["file_no"], n, page, len(payload), hashlib.sha256(payload).hexdigest()), strict=True):
                        found[k].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(found.values(), types, strict=True)], names=list(found))

    return common.dealt(arc_files, "file_no").mapInArrow(read, PLACES)


def convert(arc_files: DataFrame) -> DataFrame:
    """WARC files of the ARC files; their list comes back."""
    folder = common.shared_folder(arc_files.sparkSession, "warc")
    places = common.stored(list_records(arc_files), "arc-records")
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)), "page_id", "file_no", "record_no")
    firsts = (
        places.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "f.page_id", "f.file_no", "f.record_no")
        .toDF("digest", "first_page", "first_file", "first_record")
    )
    # The stored side is read plainly, so that a digest with a great share of the rows can be split at run time.
    decided = places.join(common.stored(firsts, "first-holders"), "digest", "left").where(
        "first_file is not null and (first_file <> file_no or first_record <> record_no)"
    )
    revisits = decided.select("file_no", "record_no", "first_page", "first_file", "first_record")
    heads = arc_files.select("file_no", F.lit(-1).cast("long").alias("record_no"), "path")
    rows = heads.unionByName(revisits, allowMissingColumns=True).select(
        "file_no", "record_no", "path", "first_page", "first_file", "first_record"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file's own row, then its revisits in the order of the file."""
        system, base = common.open_folder(folder)
        rows = (r for b in batches for r in b.to_pylist())
        row = next(rows, None)
        while row is not None:
            number, path, n = row["file_no"], f"{base}/{row['file_no']:06d}.warc.gz", 0
            draft = common.attempt_name(path)
            with opened(row["path"]) as source, system.open_output_stream(draft, compression=None) as sink:
                row = next(rows, None)
                for n, record in enumerate(read_arc(source)):
                    first = None
                    if row is not None and (row["file_no"], row["record_no"]) == (number, n):
                        first = (row["first_page"], record_id(row["first_file"], row["first_record"]))
                        row = next(rows, None)
                    sink.write(member(warc_record(record, record_id(number, n), first)))
            common.finish(system, draft, path)
            yield pa.RecordBatch.from_pylist([{"file_no": number, "path": f"{folder}/{number:06d}.warc.gz", "n_records": n + 1}])

    n_files = max(1, arc_files.count())
    return common.stored(
        rows.repartitionByRange(n_files, "file_no").sortWithinPartitions("file_no", "record_no").mapInArrow(write, FILES), "warc-files"
    )


def read_back(warc_files: DataFrame) -> DataFrame:
    """Every record of the WARC files: page_id, record_id, url, warc_date, payload size and digest, record_type and
    the page that a revisit refers to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            out: list[dict] = []
            with opened(row["path"]) as source:
                for fields, block in read_warc(source):
                    _, http, payload = http_parts(block)
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    refers = fields.get("x-refers-to-page", "None")
                    out.append({
                        "page_id": int(http["x-page"]) if http["x-page"] else None, "record_id": fields["warc-record-id"],
                        "url": fields["warc-target-uri"], "warc_date": fields["warc-date"],
                        "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload_digest": digest,
                        "record_type": fields["warc-type"], "refers_to": None if refers == "None" else int(refers),
                    })
            yield pa.RecordBatch.from_pylist(out, schema=BACK)

    return common.dealt(warc_files, "file_no").mapInArrow(
        read, "page_id long, record_id string, url string, warc_date string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long",
    )


BACK = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("warc_date", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
