"""WARC archives: a writer for page tables and a sequential reader.

The writer makes one gzip member per record, in files of about ``FILE_BYTES`` in the
shared folder. A page whose payload of at least ``REVISIT_BYTES`` equals that of a
page with a smaller page_id becomes a revisit of the smallest one and stores no
payload. Which pages those are is found on digests alone, so a hot payload is
pre-aggregated to one row per task; payloads move only to meet the few revisits.
A file is written under a name of its own attempt and listed in a table, so a lost
or repeated task leaves nothing that is read.

The reader streams: blocks of compressed bytes go through an incremental zlib
object per member, records are framed by Content-Length, payload digests are
verified, and no more than one record is held.

Defined cases: a null payload is empty; rows that repeat the smallest page_id of a
payload are all responses; a null page_id is written without that field and read
back as null; an empty table gives no file and an empty result; other columns are
ignored. A digest or frame that does not hold raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.storage import materialise, scratch, table

QUERY = "op2_warc"
REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
BLOCK_BYTES = 1 << 18
LEVEL = 6
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A record's named fields and its payload."""

    fields: dict[str, str]
    payload: bytes = b""
    payload_bytes: int = field(default=0)


def encode(fields: dict[str, str], payload: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member of its own."""
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), f"Content-Length: {len(payload)}".encode(), b"", b""]
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(b"\r\n".join(head)) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(read: Callable[[int], bytes], block: int = BLOCK_BYTES) -> Iterator[Iterator[bytes]]:
    """The members of a gzip stream, each an iterator of its decompressed pieces, which must be used up in turn."""
    rest = [b""]

    def pieces() -> Iterator[bytes]:
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            data = rest[0] or read(block)
            if not data:
                raise ValueError("the archive ends within a member")
            out = inflate.decompress(data, block)
            rest[0] = inflate.unconsumed_tail or inflate.unused_data
            if out:
                yield out

    while True:
        rest[0] = rest[0] or read(block)
        if not rest[0]:
            return
        yield pieces()


def _record(pieces: Iterator[bytes]) -> Record:
    data = bytearray()
    end = -1
    while end < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record has no header")
        seen = max(0, len(data) - 3)
        data += piece
        end = data.find(b"\r\n\r\n", seen)
    lines = bytes(data[:end]).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("a record begins without its version")
    fields = {k.strip().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(fields["Content-Length"])
    data = data[end + 4 :]
    for piece in pieces:
        data += piece
    if len(data) != size + 4 or data[size:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    return Record(fields, bytes(data[:size]))


def read_records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """Records in order. Checks the payload digest of every record that holds its payload."""
    for pieces in members(read):
        record = _record(pieces)
        digest = record.fields.get("WARC-Payload-Digest", "")
        if record.fields.get("WARC-Type") != "revisit" and digest:
            if digest != "sha256:" + hashlib.sha256(record.payload).hexdigest():
                raise ValueError(f"digest differs in {record.fields.get('WARC-Record-ID')}")
        yield record


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else "file://" + folder)


def _record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _fields(row: dict) -> dict[str, str]:
    out = {"WARC-Type": "revisit" if row["refers_to"] is not None else "response", "WARC-Record-ID": _record_id(row["page_id"])}
    if row["page_id"] is not None:
        out["WARC-Page-ID"] = str(row["page_id"])
    if row["url"] is not None:
        out["WARC-Target-URI"] = "".join(ch if ch > "\x1f" else f"%{ord(ch):02X}" for ch in row["url"])
    out |= {"WARC-Payload-Digest": f"sha256:{row['digest']}", "WARC-Payload-Length": str(row["size"])}
    if row["refers_to"] is not None:
        out |= {"WARC-Refers-To": _record_id(row["refers_to"]), "WARC-Refers-To-Page": str(row["refers_to"]), "WARC-Profile": PROFILE}
    return out


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    store, base = _open(folder)
    out, name, n, size = None, "", 0, 0

    def done() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_pydict({"path": [name], "n": [n]})

    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(name, compression=None)
            payload = b"" if row["refers_to"] is not None else (row["html"] or "").encode("utf-8")
            data = encode(_fields(row), payload)
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= file_bytes:
                yield done()
                out = None
    if out is not None:
        yield done()


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into ``folder``; the table of written files (path, n)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    light = rows.where(F.col("size") >= revisit_bytes).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    again = light.distinct().join(first, "digest").where("page_id > refers_to")
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    marked = rows.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    marked = marked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")
    return materialise(marked.mapInArrow(lambda b: _write(b, folder, file_bytes), "path string, n long"), "archives")


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, _ = _open(folder)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with store.open_input_stream(path, compression=None) as stream:
                rows, held = [], 0
                for r in read_records(stream.read):
                    f = r.fields
                    size = int(f["WARC-Payload-Length"]) if f["WARC-Type"] == "revisit" else len(r.payload)
                    rows.append(
                        {"page_id": number(f.get("WARC-Page-ID")), "url": f.get("WARC-Target-URI"), "record_type": f["WARC-Type"], "payload_digest": f["WARC-Payload-Digest"].partition(":")[2], "payload_bytes": size, "refers_to": number(f.get("WARC-Refers-To-Page")), "payload": r.payload if payloads else None}
                    )
                    held += len(r.payload) if payloads else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files in ``path``; one task reads a file from its start to its end."""
    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(lambda b: _read(b, folder, payloads), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""
