"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

write_archives() writes the records of each partition as one gzip stream, the form in which many
archives come. normalise() inflates each such stream once, writes every record as a gzip member of
its own and an index beside it (`.idx`: offset and length of each member). read_archives() then opens
single members through the index. Which record is a response and which revisits it is settled
before, by an aggregation on payload digests with map-side combine; on the way back to the pages the
most frequent digests are broadcast (a fixed number), so that none of them lands in one task.

Defined cases: a null payload is an empty one; of equal payloads of at least `min_bytes` bytes the
largest page_id is the response (a null page_id is smaller than any other; rows that share the largest are
all responses); a null url gives an empty target; an empty table gives no file.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_frequent, shared_dir, slices, stored
from quarry.llm.token_files import filesystem

_CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    size, key = F.octet_length("payload"), F.unhex(F.sha1("payload"))
    first = rows.where(size >= min_bytes).groupBy(key.alias("key")).agg(F.count("*").alias("c"), F.max("page_id").alias("top")).where("c > 1")
    keyed = join_frequent(rows.withColumn("key", F.when(size >= min_bytes, key)), stored(first, "warc-copies"), "key", "c", ["page_id", "url"])
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return keyed.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """One gzip stream of records per partition; returns a row per file: file, records."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name = f"{TaskContext.get().partitionId():06d}.warc.gz"
        temp, n, sink = f"{path}/{name}.{uuid.uuid4().hex}", 0, None
        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in slices(batches):
            sink = sink or fs.open_output_stream(temp)
            for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                sink.write(gz.compress(record(page_id, url, payload, digest(payload), refers, date)))
                n += 1
        if sink:
            sink.write(gz.flush())
            sink.close()
            fs.move(temp, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return stored(records.mapInArrow(write, "file string, records bigint"), "warc-files")


def records_of(stream) -> Iterator[bytes]:
    """The records of a gzip stream of one or more members, inflated once; holds one record at a time."""
    buffer, need, inflate = bytearray(), None, zlib.decompressobj(31)
    raw = b""
    while True:
        if not raw:
            raw = stream.read(_CHUNK)
            if not raw:
                break
        buffer += inflate.decompress(raw, _CHUNK)
        raw = inflate.unconsumed_tail
        if inflate.eof:
            raw, inflate = inflate.unused_data, zlib.decompressobj(31)
        while True:
            if need is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
                need = end + 8 + int(re.search(rb"(?im)^content-length:\s*(\d+)", bytes(buffer[:end]))[1])
            if need is None or len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError(f"{len(buffer)} bytes after the last whole record")


def normalise(files: DataFrame, source: str, folder: str, level: int = 1, keep: bool = False) -> DataFrame:
    """Rewrites each file with a gzip member per record and an index beside it; returns the index: file, offset, length.

    Unless `keep`, a task removes the monolithic file once its successor is whole; a task that runs
    again then finds the successor and reads the index from it.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        origin = filesystem(source)[1]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                old, new = f"{origin}/{name}", f"{path}/{name}"
                if fs.get_file_info(f"{new}.idx").type == pa.fs.FileType.NotFound:
                    _rewrite(fs, old, new, level)
                if not keep and fs.get_file_info(old).type != pa.fs.FileType.NotFound:
                    fs.delete_file(old)
                with fs.open_input_stream(f"{new}.idx", compression=None) as index:
                    spans = [tuple(map(int, line.split())) for line in index.read().splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(spans)), pa.array([a for a, _ in spans], pa.int64()), pa.array([n for _, n in spans], pa.int64())], names=["file", "offset", "length"])

    many = max(1, files.sparkSession.sparkContext.defaultParallelism)
    dealt = files.select("file").repartition(many * 4, "file")
    return stored(dealt.mapInArrow(rewrite, "file string, offset bigint, length bigint"), "warc-index")


def _rewrite(fs, old: str, new: str, level: int) -> None:
    mark, at, spans = uuid.uuid4().hex, 0, []
    with fs.open_input_stream(old, compression=None) as stream, fs.open_output_stream(f"{new}.{mark}") as out:
        for rec in records_of(stream):
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = gz.compress(rec) + gz.flush()
            out.write(member)
            spans.append(f"{at} {len(member)}\n")
            at += len(member)
    with fs.open_output_stream(f"{new}.idx.{mark}") as out:
        out.write("".join(spans).encode())
    fs.move(f"{new}.{mark}", new)
    fs.move(f"{new}.idx.{mark}", f"{new}.idx")  # last: its presence says that the file is whole


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """A row per record, from the files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is hashed again and held against its header; a revisit has its figures in its headers.
    """
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in slices(batches, 4096):
            rows: list[tuple] = []
            name = stream = None
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{path}/{file}")
                rows.append(_parse(zlib.decompress(stream.read_at(length, offset), 31)))
            if stream:
                stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    dealt = index.repartition("file", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _parse(rec: bytes) -> tuple:
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s or "")) else None
    return number(fields["warc-record-id"]), size, sha1, fields["warc-type"], number(fields.get("warc-refers-to"))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes, normalises and reads back: a row per page."""
    spark = pages.sparkSession
    whole, members = shared_dir(spark, "warc-whole"), shared_dir(spark, "warc")
    files = write_archives(with_references(pages, min_bytes), whole)
    return read_archives(normalise(files, whole, members), members)
