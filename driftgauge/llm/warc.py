"""Operator 5, WARC: a writer and a splittable reader.

*Writer.* Every page is a gzip member of its own. Of pages with equal payloads of at
least ``dedup_bytes`` bytes, that with the largest id is written in full, the others
as revisit records that refer to it. The digests of repeated payloads come from a
grouped maximum of digests with a map-side combine, and are joined to the pages. Of a
payload that a third of all pages share, the digest is hot: its row is broadcast (ten
thousand such rows at most), and its revisits drop their payload before the exchange,
where a salt deals them over all tasks. Each task writes files of its own under new names and returns them as rows;
the rows are committed as a manifest. A task that runs again after a lost executor
writes new files, and files that the manifest doesn't name are never read.

*Reader.* A task gets a byte range of a file. It scans for the gzip magic, takes each
place as a candidate, and validates it by decoding: the member must inflate to a WARC
version line and header whose Content-Length is the length of its block, and must be
followed by the end of the file or by the magic again. It owns the records that start
inside its range, and reads the last of them beyond its end. So ranges need no index,
and no record is lost or read twice.

Edge cases: a null or empty page has an empty payload and is a response; a null url
has no target; a null page_id is read back as null and never is the response of a
group that has other ids; a repeated row (same id and payload) is written as often as
it occurs; control characters in a url are percent-encoded, so it can't forge header
lines. A payload that itself holds whole gzip members of WARC records, stored without
compression, could be taken for records by a range that starts inside it; text can't
hold the magic, so pages are safe. An empty table makes no archive and gives no row;
further columns, whatever their names, are ignored; of equal payloads under one largest
id (ties), each row with that id is a response; a payload of any length is one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, spread_join, table, text_of

MAGIC = b"\x1f\x8b\x08"
DEDUP_BYTES = 1000
FILE_BYTES = 256 << 20
SPLIT_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def plan_records(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    rows = pages.select("page_id", "url", text_of("html").cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("_sha"))
    repeated = rows.where(F.col("payload_bytes") >= dedup_bytes).groupBy("_sha").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n"))
    repeated = materialise(repeated.where("_n > 1"), "warc-repeated")

    def revisits(found: Column) -> Column:
        keep = found["_keep"]
        return keep.isNotNull() & ~keep.eqNullSafe(F.col("page_id"))

    joined = spread_join(rows, repeated, "_sha", "_n", pages.count(), ["page_id", "url"], drop=("payload", revisits))
    refers = F.when(revisits(F.col("found")), F.col("found._keep"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", F.lower(F.hex("_sha")).alias("payload_digest"), refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, as a gzip member. Without payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, out: str, dedup_bytes: int = DEDUP_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below ``out``, a folder that all executors share; returns the manifest: path, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        path, file, size, n = "", None, 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if file is None:
                    path, size, n = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(path, compression=None)
                data = record(*row)
                file.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    file.close()
                    done.append((path, size, n))
                    file = None
        if file is not None:
            file.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return materialise(plan_records(pages, dedup_bytes).mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Bytes:
    """Buffered reads at a place of a file."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.base, self.data = file, size, block, 0, b""

    def at(self, p: int) -> memoryview:
        """What is buffered from p on; at least four bytes unless the file ends."""
        if not self.base <= p or p + 4 > self.base + len(self.data) and self.base + len(self.data) < self.size:
            self.base, self.data = p, self.file.read_at(min(self.block, self.size - p), p) if p < self.size else b""
        return memoryview(self.data)[p - self.base :]


def member(source: _Bytes, p: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the record whose gzip member starts at p; None if there is none."""
    z, out, end = zlib.decompressobj(31), bytearray(), p
    try:
        while not z.eof:
            data = source.at(end)
            if not data:
                return None
            out += z.decompress(data)
            end += len(data) - len(z.unused_data)
            if out[:5] != b"WARC/"[: len(out)]:
                return None
    except zlib.error:
        return None
    head, sep, rest = bytes(out).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = fields.get("content-length", "")
    if not sep or "warc-type" not in fields or not n.isdigit() or rest[int(n) :] != b"\r\n\r\n":
        return None
    follow = bytes(source.at(end)[:3])
    return (fields, rest[: int(n)], end) if end == source.size or follow == MAGIC else None


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end)."""
    source, p = _Bytes(file, size), start
    while p < min(end, size):
        data = source.at(p)
        k = bytes(data).find(MAGIC) if data[:3] != MAGIC else 0
        if k < 0:
            p += max(1, len(data) - 2)
            continue
        p += k
        if p >= end:
            return
        found = member(source, p)
        if found is None:
            p += 1
            continue
        yield found[:2]
        p = found[2]


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def read_warc(manifest: DataFrame, out: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """A row for each record of the manifest's files; payload too if asked for (null for revisits)."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(out)
        types = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * with_payload
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(path) as file:
                    rows = []
                    for fields, block in records_in(file, size, start, start + split_bytes):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        if kind := fields["warc-type"] == "response":
                            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
                            length, digest = int(m[1]) if m else None, base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
                        rows.append((_page(fields.get("warc-record-id")), length, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), *[payload if kind else None] * with_payload))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = READ + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    return ranges.repartition(int(min(n, 100_000)), "path", "start").mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT payload_digest AS d, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN g ON d = payload_digest
"""
