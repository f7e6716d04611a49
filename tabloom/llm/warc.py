"""WARC archives written index first and read back by coalesced byte ranges.

Each task writes its pages as WARC 1.1 records, every record a gzip member of
its own, to archives of bounded size in the shared folder, and returns one
index row per record: archive, offset, length, URL, digest. The index is a
table; a reader selects rows of it like of any table, sorts them by archive
and offset, joins neighbouring ranges and fetches each joined range with one
read. An archive of a lost task attempt is named by no index row.

Folders are reached through pyarrow's file systems (local or mounted folders,
s3, gs, hdfs), by their URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import bounded, shared_folder, stage

ARCHIVE_BYTES = 256 << 20   # an archive is closed once it is longer
GAP_BYTES = 64 << 10        # ranges this close are fetched together
RANGE_BYTES = 8 << 20       # a joined range ends once it is longer
READ_BYTES = 128 << 20      # archive bytes that a task reads, about
LEAST_BYTES = 1 << 20       # or this few, while the reading takes fewer tasks than a shuffle has partitions
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("archive string, offset long, length long, url string, digest string, "
         "page_id long, record_type string, refers_to long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def _open(uri: str):
    """(file system, path) of a folder URI; Spark writes local ones as file:/x."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: a response, or a revisit (HTTP head only) if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)),
            ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; the payload length of a revisit is that of its HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
    number = lambda name: int(m[1]) if (m := re.search(r"page:(-?\d+)", fields.get(name, ""))) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(body) != length or sha1_base32(body) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
            "payload_bytes": length, "payload_digest": digest,
            "payload": body if fields["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                   folder: str | None = None) -> DataFrame:
    """Write one record per row and return the staged index (columns of ``INDEX``).

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, that
    with the smallest id is the response and the others revisit it. A null
    payload is empty; a null URL has no target header; a null id is never the
    smallest, and payloads known only under null ids are all responses. A row
    repeated with the smallest id is a response each time.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    key = F.sha2("payload", 256)
    first = stage(src.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy(key.alias("sha"))
                  .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    first = bounded(first, first.count(), 96)
    marked = src.withColumn("sha", key).join(first, "sha", "left").select(
        "id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        out = name = None
        try:
            for batch in batches:
                rows = []
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is not None and out.tell() > ARCHIVE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    page_id, url, payload, refers_to = r
                    digest = sha1_base32(payload)
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = gz.compress(record_bytes(page_id, url, payload, digest, refers_to, date)) + gz.flush()
                    rows.append((name, out.tell(), len(data), url, digest, page_id,
                                 "response" if refers_to is None else "revisit", refers_to))
                    out.write(data)
                if rows:
                    cols = zip(*rows)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                             pa.int64()]
                    names = [c.split()[0] for c in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    return stage(marked.mapInArrow(write, INDEX).withColumn(
        "archive", F.concat(F.lit(f"{folder}/"), F.col("archive"))), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES):
    """Join sorted (offset, length) ranges at most ``gap`` apart: (offset, length, members)."""
    out: list[list] = []
    for k, (at, n) in enumerate(ranges):
        if out and at - (out[-1][0] + out[-1][1]) <= gap and out[-1][1] < most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2].append(k)
        else:
            out.append([at, n, [k]])
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows (columns of ``RECORD``), read by sorted byte ranges.

    The number of tasks follows the bytes of the selected records. Repeated index rows give repeated records; an empty selection reads nothing.
    """
    def read(batches):
        import pyarrow as pa
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        opened, stream = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            found, lo = [], 0
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and rows[hi][0] == rows[lo][0]:
                    hi += 1
                if rows[lo][0] != opened:
                    if stream is not None:
                        stream.close()
                    folder, _, name = rows[lo][0].rpartition("/")
                    files, base = _open(folder)
                    opened, stream = rows[lo][0], files.open_input_file(f"{base}/{name}")
                part = [r[1:] for r in rows[lo:hi]]
                for at, n, members in coalesced(part):
                    data = stream.read_at(n, at)
                    for k in members:
                        off, size = part[k]
                        rec = parse_record(zlib.decompress(data[off - at:off - at + size], 31))
                        if not payloads:
                            rec["payload"] = None
                        found.append(rec)
                lo = hi
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, types)],
                                                 names=names)
        if stream is not None:
            stream.close()
    size = index.agg(F.sum("length")).first()[0] or 0
    usual = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-size // READ_BYTES), min(usual, -(-size // LEAST_BYTES)))
    return (index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
            .sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS d FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(d, 1 + (i // 4) * 5, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM m
"""


def op9_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
