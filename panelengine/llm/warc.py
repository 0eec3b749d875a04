"""Web archives, index first.

Each page becomes a gzip-compressed record of a WARC file in the shared folder; the task that
writes it returns an index row with file, offset, length, URL and digest, and the index is
written as a table before anything is read. A reader selects index rows, sorts them by file
and offset, coalesces neighbouring byte ranges into few large reads, and takes the records
from those. Equal payloads are stored once: later pages are revisits of the first.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_table, dealt_anew, prepare, shared_path

#: payloads from this size on are stored once
MIN_REVISIT_BYTES = 0
#: an archive is closed at this size
ARCHIVE_BYTES = 512 << 20
#: byte ranges this near to each other are read at once, up to so many bytes
GAP, READ_BYTES = 64 << 10, 8 << 20
DATE = "2020-01-01T00:00:00Z"

INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP head alone, whose Content-Length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if original is None else original}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse(data: bytes) -> tuple:
    """The fields of RECORDS of one record; a response's digest and length are taken from the
    payload itself and held against the head's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (size != len(payload) or digest != sha1_base32(payload)):
        raise ValueError(f"record {named['WARC-Record-ID']} does not have the payload it names")
    refers = _page(named["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), size, digest, kind, refers, payload if kind == "response" else None


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row of ``pages`` to archives in ``folder``, return their index.

    A null html is an empty payload. Of rows with equal payloads the one with the smallest id
    (null last; ties: the first in the table) is the response. A task that is run again
    writes new files; the index names those of the run that counted, others are left over.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    groups = rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    groups = groups.where("first <> last").select("sha1", "first")
    marked = rows.join(dealt_anew(groups), "sha1", "left").select(
        "page_id", "url", "payload", "sha1", F.col("first.page_id").alias("original"), (F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))).alias("revisit")
    )
    out = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        stream, name, at = None, "", 0
        try:
            for b in batches:
                index = []
                for r in b.to_pylist():
                    if stream is None:
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"], digest, r["original"], r["revisit"]), 1, mtime=0)
                    stream.write(data)
                    index.append({"page_id": r["page_id"], "file": name, "offset": at, "length": len(data), "url": r["url"], "digest": digest})
                    at += len(data)
                    if at >= archive_bytes:
                        stream.close()
                        stream = None
                yield pa.RecordBatch.from_pylist(index, schema=out)
        finally:
            if stream is not None:
                stream.close()

    return as_table(marked.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = False, gap: int = GAP, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records that ``index`` (any selection of its rows) names, with the fields of RECORDS.
    Tasks get stretches of a file, sorted by offset; ranges at most ``gap`` bytes apart are
    read at once."""
    prepare(index.sparkSession)
    places = index.select("file", "offset", "length")
    places = places.repartition("file", F.floor(F.col("offset") / read_bytes)).sortWithinPartitions("file", "offset")
    schema = RECORDS if with_payload else T.StructType(RECORDS.fields[:-1])
    out = to_arrow_schema(schema)

    def ranges(batches):
        """Lists of (file, offset, length) to be read at once."""
        together: list = []
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if together and (
                    together[-1][0] != file or offset - together[-1][1] - together[-1][2] > gap or offset + length - together[0][1] > read_bytes
                ):
                    yield together
                    together = []
                together.append((file, offset, length))
        if together:
            yield together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        stream, name = None, None
        for together in ranges(batches):
            file, start = together[0][:2]
            if name != file:
                if stream is not None:
                    stream.close()
                stream, name = system.open_input_file(f"{root}/{file}"), file
            data = stream.read_at(together[-1][1] + together[-1][2] - start, start)
            rows = [parse(zlib.decompress(data[o - start : o - start + n], 31))[: len(out)] for _, o, n in together]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        if stream is not None:
            stream.close()

    return places.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives, read every record back: RECORDS without the payloads."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, **options), folder)
