"""WARC archives written per task, and read back index first.

*Writing.* Each task writes its pages as gzip members, one per record, into archives
of at most ``ARCHIVE_BYTES``. Of pages with equal payloads the one with the smallest
id is the response and the rest are revisit records that name its digest and
target. Which page that is comes from a grouped minimum over (digest, size), so a
payload may be shared by any share of the rows; no html is shuffled for pages that
are alone. A response's record id follows from its page and digest, so a revisit in any
archive names it in WARC-Refers-To; where equal rows (same id and payload) are responses,
their ids follow from their places and the page id alone tells which is meant. Each
archive opens with a warcinfo record. The task returns one index row per record:
archive, offset, length, URL, digest and ids. Archives are first written under a name of the attempt's own and
only count through the index rows that Spark commits, so a repeated or lost task
leaves nothing that is read.

*Reading.* The selected index rows are sorted by archive and offset and neighbouring
byte ranges (gaps up to ``GAP_BYTES``) are read with one request of at most
``READ_BYTES``; each member is then decompressed and parsed on its own.

Archives go through ``pyarrow.fs`` to the shared folder, whatever store its URI
names. Defined results: null html is an empty payload; equal rows (same id and
payload) are all responses; a null id is always a response and never referred to;
a url is percent-encoded in the record and kept as it was in the index, a null one is
an empty target; other columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm._work import forget, fresh_path, put, qualified, short_batches, tidy

ARCHIVE_BYTES = 128 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
INDEX = "page_id long, url string, archive string, offset long, length long, digest string, record_type string, refers_to long"
_NAMES = ["page_id", "url", "archive", "offset", "length", "digest", "record_type", "refers_to"]
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps archives reproducible
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*about: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, about)))}>"


def _block(head: list[str], body: bytes) -> bytes:
    head = ["WARC/1.1", *head, f"WARC-Date: {_DATE}", f"WARC-Block-Digest: sha1:{digest32(body)}", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def warcinfo(archive: str) -> bytes:
    """The record that opens an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(archive)}", f"WARC-Filename: {archive}", "Content-Type: application/warc-fields"]
    return _block(head, b"software: kinframe\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, own_id: str, other_id: str | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit with the response's headers alone.

    ``other_id`` is the record id of the response that a revisit refers to.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    target = quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"X-Refers-To-Page-ID: {refers_to}"] + [f"WARC-Refers-To: {other_id}"] * (other_id is not None)
    return _block(head, body)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(warc["Content-Length"])]
    http_head, _, payload = body.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


def _gzip(raw: bytes) -> bytes:
    made = zlib.compressobj(4, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def _open_store(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(base)


def write_warc(pages: DataFrame, base: str | None = None, min_payload_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write archives and their index under ``base``; the folder's URI.

    Payloads below ``min_payload_bytes`` are never revisits.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    base = base or fresh_path(spark, "warc")
    base = qualified(spark, base)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    html = F.coalesce("html", F.lit(""))
    small = own.where("page_id IS NOT NULL").select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    small = put(small.groupBy("page_id", "digest", "n").agg(F.count("*").alias("copies")), "digests")
    first = small.where(F.col("n") >= min_payload_bytes).groupBy("digest", "n").agg(F.min_by(F.struct("page_id", "copies"), "page_id").alias("first"), F.max("page_id").alias("last"))
    first = put(first.where("first.page_id < last").select("digest", "n", F.col("first.page_id").alias("refers_to"), (F.col("first.copies") == 1).alias("known")), "first")
    # one row per id and payload, so an id that is repeated with many payloads meets each row once
    again = small.join(first, ["digest", "n"], "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("refers_to"), F.col("refers_to")))
    # several equal rows can't share a record id
    again = again.where("copies > 1 OR refers_to IS NOT NULL").select("page_id", "digest", "copies", "refers_to", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open_store(base)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, text, copies, refers, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (text or "").encode()
                    digest = digest32(payload)
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        opening = _gzip(warcinfo(name))
                        out.write(opening)
                        at = len(opening)
                    alone = page_id is not None and (copies or 1) == 1
                    own_id = record_id(page_id, digest) if alone else record_id(page_id, digest, name, at)
                    other_id = record_id(refers, digest) if refers is not None and known else None
                    member = _gzip(record(page_id, url, payload, digest, refers, own_id, other_id))
                    out.write(member)
                    rows.append((page_id, url, name, at, len(member), digest, "response" if refers is None else "revisit", refers))
                    at += len(member)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                columns = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)
        finally:
            if out is not None:
                out.close()

    own = own.withColumn("digest", F.sha1(html.cast("binary")))
    joined = own.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "copies", "refers_to", "known")
    with short_batches(spark):
        joined.mapInArrow(tidy(run), INDEX).write.mode("overwrite").parquet(f"{base}/index")
    forget(small, first)
    return base


def read_index(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{base}/index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) ranges as (offset, length, number of ranges) reads."""
    out: list[list[int]] = []
    for at, n in ranges:
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([at, n, 1])
    return [tuple(x) for x in out]


def read_warc(spark: SparkSession, base: str, selected: DataFrame | None = None, keep_html: bool = False) -> DataFrame:
    """Records of the selected index rows (default: all), parsed from the archives.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to (and html,
    null for revisits). A digest that doesn't match its payload raises.
    """
    import pyarrow as pa


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open_store(base)
        opened, source = "", None
        for batch in batches:
            archive, offset, length, urls = (batch.column(i).to_pylist() for i in range(4))
            rows, k = [], 0
            while k < len(archive):
                end = k
                while end < len(archive) and archive[end] == archive[k]:
                    end += 1
                if archive[k] != opened:
                    opened, source = archive[k], store.open_input_file(f"{folder}/{archive[k]}")
                for at, n, many in coalesce_ranges(list(zip(offset[k:end], length[k:end], strict=True))):
                    source.seek(at)
                    block = source.read(n)
                    for _ in range(many):
                        lo = offset[k] - at
                        warc, http, payload = parse(zlib.decompress(block[lo : lo + length[k]], 31))
                        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = warc["WARC-Type"]
                        if kind == "response" and digest32(payload) != digest:
                            raise ValueError(f"digest of record at {archive[k]}:{offset[k]} doesn't match its payload")
                        page, refers = warc["X-Page-ID"], warc.get("X-Refers-To-Page-ID", "")
                        row = [int(page) if page else None, urls[k], int(http["Content-Length"]), digest, kind, int(refers) if refers else None]
                        rows.append(row + [payload.decode() if kind == "response" else None] * keep_html)
                        k += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * keep_html
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * keep_html
    index = selected if selected is not None else read_index(spark, base)
    # archives are of bounded size, so an archive is a bounded share of a task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = index.select("archive", "offset", "length", "url").repartition(parts, "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    return plan.mapInArrow(tidy(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * keep_html)
