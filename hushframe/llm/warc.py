"""WARC archives: written as one gzip stream per file, then normalised to one gzip member per record.

The normaliser inflates each monolithic file once, as a stream, writes every record as a member of its
own, and beside the file a sidecar index (`.idx`, a JSON line per record with its offset and length), so
that a reader gets one record by one seek.

Of pages with equal payloads of at least `least` bytes, the one with the smallest page_id is a response
and the others are revisits that name it; smaller payloads are always responses. Payloads meet by their
SHA-256; only digests that occur twice are joined back to the pages.

Defined cases: null html is an empty payload; a null page_id is written without an id, and is a revisit
only if its group has a page with one; pages that repeat the smallest page_id of their group are all
responses; a null url leaves the target out, line breaks in a url are escaped; an empty table gives an
archive without records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, settle, shared_files, slices

_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "part int, path string, records long"


def decided(pages: DataFrame, least: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_digest and refers_to: the response's page_id for revisits, else null."""
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    long = rows.where(F.octet_length("html") >= least)
    groups = settle(
        long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "same-payload"
    )
    return rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", F.expr("CASE WHEN NOT page_id <=> first_id THEN first_id END").alias("refers_to")
    )


def _record_id(page_id: int | None) -> str:
    name = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id}")
    return f"<urn:uuid:{name}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Head fields, block and all bytes of each record of an inflated stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        raw, fields = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            raw.append(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        raw += [b"\r\n", block, stream.read(4)]
        if raw[-1] != b"\r\n\r\n":
            raise ValueError("a record does not end as it should")
        yield fields, block, b"".join(raw)


def write_monolithic(pages: DataFrame, folder: str, least: int = 100, level: int = 4) -> DataFrame:
    """One gzip stream per partition; returns the table of committed files, stored in `folder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, base = shared_files(folder)
        files.create_dir(base, recursive=True)
        path, records = f"{base}/mono-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0
        with files.open_output_stream(path, compression=None) as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=level, mtime=0) as stream:
            for batch in slices(batches, 2):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    stream.write(record(page_id, url, html.encode(), digest, refers_to))
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([records])], ["part", "path", "records"])

    decided(pages, least).mapInArrow(run, _FILES).write.parquet(f"{folder}/monolithic")
    return pages.sparkSession.read.schema(_FILES).parquet(f"{folder}/monolithic")


def normalise(listed: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite listed files (path) with a gzip member per record and a sidecar index; returns the table of new files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = shared_files(folder)
        files.create_dir(base, recursive=True)
        for frame in frames:
            for part, source in zip(frame["part"].tolist(), frame["path"].tolist()):
                path, at, records = f"{base}/part-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                with files.open_input_stream(source, compression=None) as packed, files.open_output_stream(path, compression=None) as out, files.open_output_stream(f"{path}.idx") as index:
                    for fields, _, raw in parse(gzip.GzipFile(fileobj=packed)):
                        squeeze = zlib.compressobj(level, wbits=31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        entry = {"id": fields["warc-record-id"], "page": fields.get("x-page-id"), "type": fields["warc-type"], "offset": at, "length": len(member)}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, records = at + len(member), records + 1
                yield pd.DataFrame({"part": [part], "path": [path], "records": [records]})

    spark = listed.sparkSession
    spread = listed.select("part", "path").repartition(max(1, listed.count()))
    spread.mapInPandas(run, _FILES).write.parquet(f"{folder}/files")
    return spark.read.schema(_FILES).parquet(f"{folder}/files")


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head fields and block of the record whose member lies there."""
    file.seek(offset)
    fields, block, _ = next(parse(io.BytesIO(zlib.decompress(file.read(length), wbits=31))))
    return fields, block


def read(listed: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes and payload_digest per record.

    The digest and length of a response are taken from its payload and held against its head.
    """

    def row(fields: dict[str, str], block: bytes) -> tuple:
        number = lambda name: int(fields[name]) if name in fields else None
        payload, size, digest = None, number("x-payload-bytes"), fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
        return number("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], number("x-refers-to-page"), payload, size, digest

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = shared_files(folder)
        for frame in frames:
            for path in frame.column("path").to_pylist():
                with files.open_input_file(path) as file, files.open_input_stream(f"{path}.idx") as index:
                    rows, size = [], 0
                    for line in _lines(index):
                        entry = json.loads(line)
                        rows.append(row(*read_member(file, entry["offset"], entry["length"])))
                        size += rows[-1][5]
                        if size > 8_000_000:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, schema)

    spread = listed.select("path").repartition(max(1, listed.count()))
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *lines, rest = (rest + chunk).split(b"\n")
        yield from lines


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def archive(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write, normalise and read back; the records as `read` gives them."""
    return read(normalise(write_monolithic(pages, f"{folder}/mono", least), f"{folder}/members"), f"{folder}/members")


def reread(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive that was written before."""
    return read(spark.read.schema(_FILES).parquet(f"{folder}/members/files"), f"{folder}/members")
