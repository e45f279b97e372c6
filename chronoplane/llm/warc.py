"""WARC archives: written as one gzip stream, normalised to a member per record.

Pages are written as WARC records by Spark's own text writer, which compresses
each file as one monolithic gzip stream.  The normaliser inflates such a file
once, as a stream, writes every record again as a gzip member of its own, and
writes a sidecar index with the place of each member.  A reader then fetches any
record by its offset and length.

Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with
the largest page_id is stored; the others are revisit records that name it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.shared import filesystem, materialize, scratch_path

LEAST_REVISIT = 1000
#: Date of all records: archives of equal pages are equal.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
CHUNK = 1 << 20
#: Records of one archive at most.
RECORDS = 20_000

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def decide(pages: DataFrame) -> DataFrame:
    """Add payload, n (bytes), digest, and refers_to (null for a response).

    Digests are grouped without the payloads; only page ids that revisit another
    page come back to the pages.
    """
    payload = F.coalesce("html", F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    full = full.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = full.where(F.col("n") >= LEAST_REVISIT).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups.where("copies > 1").select("digest", "first"), "copies")
    revisits = large.join(groups, "digest").where("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    revisits = materialize(revisits, "revisits").withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    return full.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def _records(decided: DataFrame) -> DataFrame:
    """One WARC record per row as text, less the last line feed, which the writer adds."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    ident = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    http = text(_HTTP, F.col("n").cast("string"), "\r\n\r\n")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "")
    head = text(
        "WARC/1.0\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: <urn:page:", ident("page_id"),
        ">\r\nWARC-Target-URI: ", uri,
        f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
        "\r\nPayload-Length: ", F.col("n").cast("string"),
        F.when(revisit, text("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:", ident("refers_to"), ">")).otherwise(""),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(block).cast("string"),
        "\r\n\r\n",
    )
    return decided.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Write a record per page below ``path``, each file one gzip stream."""
    records = _records(decide(pages))
    records.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS).text(path)


_HEADERS = re.compile(rb"^([A-Za-z-]+): *(.*?)\r$", re.M)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated WARC stream, each with its closing blank lines."""
    buffer, ended = bytearray(), False
    chunks = iter(chunks)

    def fill(least: int) -> bool:
        nonlocal ended
        while len(buffer) < least and not ended:
            piece = next(chunks, None)
            ended = piece is None
            buffer.extend(piece or b"")
        return len(buffer) >= least

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                if buffer.strip():
                    raise ValueError("a WARC record is cut off in its headers")
                return
        length = int(dict(_HEADERS.findall(bytes(buffer[: end + 2])))[b"Content-Length"])
        whole = end + 4 + length + 4
        if not fill(whole):
            raise ValueError("a WARC record is cut off in its block")
        yield bytes(buffer[:whole])
        del buffer[:whole]


def _inflate(file) -> Iterator[bytes]:
    """The contents of a gzip file, of one stream or several, in pieces of bounded size."""
    stream = zlib.decompressobj(31)
    while data := file.read(CHUNK):
        while data:
            piece = stream.decompress(data, CHUNK)
            if piece:
                yield piece
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
    while piece := stream.decompress(b"", CHUNK):
        yield piece


def _member(record: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _normalise(target: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rewrite each monolithic archive, read as a stream; a repeated task writes the same files again."""
    fs, root = filesystem(target)
    fs.create_dir(root, recursive=True)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            base = hashlib.sha1(name.encode()).hexdigest()[:20]
            path, rows, at = f"{root}/{base}.warc.gz", [], 0
            draft = f"{path}.{uuid.uuid4().hex}"
            source, at_source = filesystem(name)
            with source.open_input_stream(at_source, compression=None) as file, fs.open_output_stream(draft, compression=None) as out:
                for record in split_records(_inflate(file)):
                    member = _member(record)
                    out.write(member)
                    rows.append((at, len(member)))
                    at += len(member)
            fs.move(draft, path)
            with fs.open_output_stream(f"{path}.idx", compression=None) as out:
                out.write("".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in rows).encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
                names=["archive", "offset", "length"],
            )


def normalise(spark, source: str, target: str) -> DataFrame:
    """Normalise all ``*.gz`` below ``source`` into ``target``; return the index.

    The index has a row per record: archive, offset, length.  It is also written
    beside each archive as ``.idx``, a line per record.  Only the names of the
    archives are listed here; a task reads its archive in pieces, so an archive
    may be larger than memory, a record may not.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return materialize(files.mapInArrow(lambda batches: _normalise(target, batches), "archive string, offset long, length long"), "index")


def _read(target: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, _ = filesystem(target)
    number = lambda x: None if x == b"null" else int(x)
    name, file = None, None
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            if r["archive"] != name:
                if file:
                    file.close()
                name, file = r["archive"], fs.open_input_file(r["archive"])
            record = zlib.decompress(file.read_at(r["length"], r["offset"]), 31)
            end = record.index(b"\r\n\r\n")
            head = dict(_HEADERS.findall(record[: end + 2]))
            block = record[end + 4 : -4]
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            kind = head[b"WARC-Type"].decode()
            page = number(head[b"WARC-Record-ID"][len(b"<urn:page:") : -1])
            digest, size = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), int(head[b"Payload-Length"])
            if kind == "response":
                size, found = len(payload), hashlib.sha1(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"page {page}: the payload doesn't match its digest")
            refers = number(head[b"WARC-Refers-To"][len(b"<urn:page:") : -1]) if kind == "revisit" else None
            rows.append((page, head[b"WARC-Target-URI"].decode(), size, digest, kind, refers))
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    if file:
        file.close()


def read_records(index: DataFrame, target: str) -> DataFrame:
    """What each indexed record says of its page; payloads are checked by digest."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.mapInArrow(lambda batches: _read(target, batches), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, normalise the archives, read them back: a row per page.

    A null html is an empty payload.  Repeated rows are records each; rows with
    the largest page_id of their payload are all responses.  A null page_id is
    never larger than another; its record is a response.  White space is taken
    out of a url, a null one is empty.  Other columns are ignored.  An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_monolithic(pages, raw)
    return read_records(normalise(spark, raw, target), target)
