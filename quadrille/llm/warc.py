"""WARC revisit resolution and deduplicated archives.

Record headers (id, declared type, payload digest, payload size) are shuffled by
payload digest; the smallest id among the records that carry a payload is its
original.  Every other record of the digest becomes a revisit of it.  The
decisions go back to the payloads by record id, and new archives are written
with fresh headers: originals as ``response`` records, copies as ``revisit``
records that keep only their HTTP header.  A revisit whose original is not in
the set stays a revisit without ``WARC-Refers-To``.

Archives are gzip files of one member per record.  The task that owns the rows
writes an archive under a name of its own; the table of archives that finished
tasks wrote is the commit, so archives of lost tasks are never read.

Null payloads count as empty.  Payloads below ``min_bytes`` are never resolved.
A null id never is an original if the payload has another one.  Rows that repeat
both id and payload are equal records: all of the original's are responses.  A
null url leaves out the target URI; line breaks in it are percent-encoded.
Extra columns are ignored.  An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import task_filesystem, texts_of, write_table
from quadrille.llm.textkit import releasing
from quadrille.plans.session import shared_output_dir

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of conv(.., 32)
ARCHIVES = "path string, n_records long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, warc_date string"
READ_BYTES = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, RFC4648)


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Response records: page_id, url, record_type, payload, payload_digest, payload_bytes."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.lit("response").alias("record_type"), payload.alias("payload")).select(
        "*", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per (page_id, payload_digest): record_type and refers_to.

    ``records`` needs page_id, record_type, payload_digest, payload_bytes.
    """
    carries = F.col("record_type") == "response"
    heads = records.select("page_id", "payload_digest", "payload_bytes", carries.alias("carries"))
    heads = heads.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.max("carries").alias("carries"))
    heads = write_table(heads, "warc_heads")
    key = ["payload_digest", "payload_bytes"]
    originals = (heads.where(F.col("payload_bytes") >= min_bytes).groupBy(*key)
                 .agg(F.min(F.when(F.col("carries"), F.col("page_id"))).alias("original"), F.count("*").alias("n"), F.max("carries").alias("any_carries"))
                 .where((F.col("n") > 1) & F.col("any_carries")).select(*key, "original"))
    originals = write_table(originals, "warc_originals").withColumn("found", F.lit(True))
    copy = F.col("found") & ~F.col("page_id").eqNullSafe(F.col("original"))
    kind = F.when(copy, "revisit").when(F.col("carries"), "response").otherwise("revisit")
    return heads.join(originals, key, "left").select(
        "page_id", "payload_digest", kind.alias("record_type"), F.when(copy, F.col("original")).alias("refers_to"))


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def uri_id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id, url, kind, payload, digest, n_bytes, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_url(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: {record_uri(refers_to)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(records: DataFrame, out: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes records (page_id, url, record_type, payload, payload_digest, payload_bytes, refers_to)
    as archives; returns the table of archives (path, n_records)."""
    out = out or shared_output_dir(records.sparkSession, "warc")

    @releasing
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            if sink is None:
                fs, folder = task_filesystem(out)
                fs.create_dir(folder, recursive=True)
                name = f"archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                info = b"software: quadrille\r\nformat: WARC File Format 1.1\r\n"
                sink.write(member((f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
                                   f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n").encode() + info + b"\r\n\r\n", level))
            columns = [batch.column(c) for c in ("page_id", "url", "record_type", "payload", "payload_digest", "payload_bytes", "refers_to")]
            for row in zip(*columns):
                sink.write(member(record_bytes(*[v.as_py() for v in row], date), level))
            n += len(batch)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out}/{name}"], "n_records": pa.array([n], pa.int64())})

    rows = texts_of(records).select("page_id", "url", "record_type", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
                          "payload_digest", "payload_bytes", "refers_to")
    return write_table(rows.mapInArrow(write, ARCHIVES), "warc_archives")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one record each."""
    z, parts, raw = None, [], b""
    while True:
        if not raw:
            raw = stream.read(READ_BYTES)
            if not raw:
                if z is not None:
                    raise ValueError("archive ends inside a record")
                return
        if z is None:
            z, parts = zlib.decompressobj(31), []
        parts.append(z.decompress(raw))
        raw = b""
        if z.eof:
            raw, z = z.unused_data, None
            yield b"".join(parts)


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(raw: bytes) -> dict | None:
    """The fields of a response or revisit record; None for other records.

    A response's digest and size are those of the payload itself, which must
    agree with its header.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = fields_of(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    n_bytes = int(fields_of(http).get("content-length", len(payload)))
    if kind == "response":
        digest, n_bytes = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if declared and declared != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        declared = digest
    return {"page_id": uri_id(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_digest": declared, "payload_bytes": n_bytes, "refers_to": uri_id(fields.get("warc-refers-to")),
            "warc_date": fields.get("warc-date"), "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record of the archives."""
    schema = RECORDS + (", payload binary" if payloads else "")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                       ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("warc_date", pa.string())] + [("payload", pa.binary())] * payloads)

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = task_filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(where, compression=None) as stream:
                    for raw in members(stream):
                        row = parse_record(raw)
                        if row is None:
                            continue
                        rows.append({n: row[n] for n in arrow.names})
                        held += len(raw) if payloads else 0
                        if len(rows) == 4096 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(look, schema)


def deduplicate(records: DataFrame, min_bytes: int = 0, **how) -> DataFrame:
    """Resolves revisits and writes new archives; returns the table of them."""
    decided = resolve_revisits(records, min_bytes).select(
        F.col("page_id").alias("d_id"), F.col("payload_digest").alias("d_digest"), F.col("record_type").alias("d_type"), "refers_to")
    full = records.join(decided, records["page_id"].eqNullSafe(decided["d_id"]) & (records["payload_digest"] == decided["d_digest"]))
    return write_archives(full.select("page_id", "url", F.col("d_type").alias("record_type"), "payload", "payload_digest", "payload_bytes", "refers_to"), **how)
