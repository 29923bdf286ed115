"""WARC archives, index first.

Each task writes the records of its rows to an archive of its own, one gzip
member per record, under a name that no other attempt uses, and returns the
index rows (file, offset, length, URL, digest). The index is a written table,
so it names only archives whose task succeeded. Reading takes any selection of
index rows, deals them out in (file, offset) order, and joins neighbouring
byte ranges into one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import batches, scratch, stash, text_or_empty

#: Payloads of at least this many bytes are written once.
REVISIT_FROM = 0
ARCHIVE_BYTES = 1 << 30
#: Ranges closer than the first are read together, up to the second.
GAP, READ = 1 << 16, 8 << 20
#: Bytes of records that one task reads.
TASK_BYTES = 32 << 20
DATE = "2026-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def roles(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Adds refers_to: the smallest page_id with the same payload, where that is another row's.

    Only digests that occur twice are joined; the large side of that join is
    split at run time if one payload is hot.
    """
    body = F.encode(text_or_empty("html"), "UTF-8")
    dealt = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"))
    first = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(body).alias("n"), F.sha1(body).alias("first_sha1")) \
        .where(F.col("n") >= revisit_from).groupBy("first_sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return dealt.join(first, dealt["sha1"] == first["first_sha1"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record: an HTTP response, or its head alone for a revisit."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.splitlines())}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The RECORD columns of one WARC record; ValueError if a response's payload does not have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None, digest, size, None if revisit else payload


def write(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) below `folder` (a URI); returns the index.

    Of rows with equal payloads of at least `revisit_from` bytes the smallest
    page_id is a response, the others are revisits of it. A null html is an
    empty payload. Rows that repeat the smallest page_id are responses too, as
    are equal payloads of which no row has a page_id. Line breaks in a URL
    become spaces; a null URL stays null. A very long page is one record.
    Other columns are not read. An empty table has an empty index.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, at = "", None, 0
        try:
            for part in parts:
                rows = []
                for page_id, url, payload, refers_to in zip(part["page_id"], part["url"], part["payload"], part["refers_to"], strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    payload, ids = bytes(payload), [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = gz.compress(record(ids[0], url, payload, ids[1], digest)) + gz.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, ids[0]))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "payload_digest", "page_id"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return stash(batches(roles(pages, revisit_from)).mapInPandas(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, most: int = READ, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that the rows of an index (all, or any selection) name, with or without their payloads.

    Rows of the index that repeat are read as often. Ranges go to tasks in the
    order of their places, about `task_bytes` of records to each.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        name, source = "", None
        try:
            for part in parts:
                rows, records = list(zip(part["file"], part["offset"], part["length"], strict=True)), []
                i = 0
                while i < len(rows):
                    file, start, length = rows[i]
                    end, j = start + length, i + 1
                    while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= most:
                        end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, store.open_input_file(file)
                    raw = source.read_at(end - start, start)
                    for _, a, n in rows[i:j]:
                        found = parse(zlib.decompress(raw[a - start : a - start + n], 31))
                        records.append(found if payloads else (*found[:-1], None))
                    i = j
                    if sum(len(r[-1] or b"") for r in records) > most:
                        yield frame(records)
                        records = []
                yield frame(records)
        finally:
            if source is not None:
                source.close()

    def frame(records: list) -> pd.DataFrame:
        return pd.DataFrame(records, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    size = index.agg(F.sum("length").alias("s")).first()["s"] or 0
    ranges = index.select("file", "offset", "length").repartitionByRange(max(1, -(-size // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    return batches(ranges).mapInPandas(run, RECORD)


def op8_warc_index_first(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and url for every row of pages, as read back; nulls, repeated rows and the like as in write()."""
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The same rows without archives.
OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
  b AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) << (5 - j)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM b
"""
