"""WARC archives: a writer with deduplication and a sequential reader (operator 1).

Writing: one record per row, each a gzip member of its own. Payload digests are SHA-1, base32 in the
records. Of equal payloads of at least ``min_bytes`` bytes the row with the largest id becomes the
response, the others become revisits that name it and hold no payload. A task writes its rows to archives of
some ``ARCHIVE_BYTES`` under a temporary name, renames each when complete and returns its name, so a task that is
run again leaves only a stray file that no manifest names; the manifest is a table in the shared folder.

Reading: a task reads its archives from front to back in pieces of ``PIECE`` bytes: incremental zlib
decompression to the end of each member, the header up to the blank line, then Content-Length bytes of
block, whose digest is verified. At no time is more than a record and a piece in memory.

Archives are reached by pyarrow's file systems, so the shared folder may be local, HDFS or an object store.
Rows are deduplicated by digest alone: digests shuffle (20 bytes a row) and are counted on the map side; only digests that
occur several times are joined back to the rows, which the planner may do by broadcast when they are few and by a
skew-splitting join when they are not.

Defined results: null payloads are empty; a null url writes no target; of equal rows with the same largest id each is
a response; in a group without any id all are responses. Record ids carry the row id (``none`` for null).
Control characters of urls are percent-encoded. An empty table writes no archive and reads no record. A payload of any length is
one record, in the memory of one task; columns other than id, url and payload are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, save, shared_dir, table, text_bytes

ARCHIVE_BYTES = 64 << 20
#: Bytes of archives that a reading task takes, once there are many.
TASK_BYTES = 512 << 20
PIECE = 1 << 18
LEVEL = 4
#: Every record bears this date; the tables have none.
DATE = "2000-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    name = "none" if page_id is None else str(page_id)
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        head.append(f"WARC-Target-URI: {safe}")
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            f"X-Payload-Length: {len(payload)}",
        ]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload`` of ``pages`` with ``refers_to``: the response's id for revisits, else null."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    long_enough = F.octet_length("payload") >= min_bytes
    repeated = keyed.filter(long_enough).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.filter("n > 1 and first is not null").select("digest", "first")
    joined = keyed.join(repeated, "digest", "left")
    refers = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``roles`` as archives below ``folder``; returns the manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(f"{root}/{name}.open", f"{root}/{name}")
                done.append((name, records, size))
                out = None

        # Some hundred rows at a time become Python objects.
        for part in (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500)):
            columns = (part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}.open", compression=None)
                packed = member(record(page_id, url, payload or b"", refers_to))
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        for name, records, size in done:
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    return save(map_arrow(rows, run, "path string, records long, bytes long"), "manifest")


class Broken(ValueError):
    """An archive that does not hold what its records say."""


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive given as pieces of its compressed bytes."""
    pending = b""
    ended = False
    while True:
        # One gzip member, fed piece by piece up to its end.
        unpacker, raw = zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            if not pending:
                pending = next(pieces, b"")
                if not pending:
                    ended = True
                    break
            raw += unpacker.decompress(pending)
            pending = unpacker.unused_data
        if ended:
            if raw:
                raise Broken("an archive ends inside a record")
            return
        head, blank, rest = bytes(raw).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not blank or not lines[0].startswith("WARC/"):
            raise Broken("a member does not start with a WARC header")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        block, end = rest[:length], rest[length:]
        if len(block) != length or end != b"\r\n\r\n":
            raise Broken(f"{headers['WARC-Record-ID']}: the block is not of the length given")
        if headers["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
            raise Broken(f"{headers['WARC-Record-ID']}: the block's digest differs")
        yield headers, block


def _id(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest; without ``payloads`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as source:
                    for headers, block in read_records(iter(lambda source=source: source.read(PIECE), b"")):
                        kind = headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest != digest_of(block):
                            raise Broken(f"{headers['WARC-Record-ID']}: the payload's digest differs")
                        length = len(block) if kind == "response" else int(headers["X-Payload-Length"])
                        rows.append((_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, digest, kind, _id(headers.get("WARC-Refers-To")), block if payloads and kind == "response" else None))
                        size += len(block) if payloads else 100
                        if size > 8 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    n, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # A task to an archive while they are few, else some TASK_BYTES of archives to a task.
    tasks = max(1, min(n, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)))
    spread = manifest.select("path").repartitionByRange(tasks, "path")
    return map_arrow(spread, run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("payload"))
    manifest = write(roles(pages, min_bytes=0), folder)
    return read(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a hex digest in SQL: 5 hex digits are 4 base32 digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY x) AS top,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""
