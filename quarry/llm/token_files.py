"""Token-id files: flat unsigned integers, with 64-bit document offsets beside them.

Documents are dealt by range of (doc_id, hash of text) and sorted, so file k holds the k-th range. Each
task encodes its documents and writes `ids-<k>.bin` (little-endian numbers, 16-bit where all ids of the
vocabulary fit and else 32-bit, or of the type asked for) and `ids-<k>.off` (64-bit starts of its documents in that
file, then the total). The bases of the files are the prefix sums of their totals, one number a file. A file is
written under a name of its own attempt and then renamed, so a task that runs again does no harm.

Defined cases: null and empty texts give the end id alone; rows with the same doc_id follow in the
order of their texts' hashes, null doc_ids first; an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, slices, stored
from quarry.llm.tokens import encoder


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, from its address, and the path there."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_whole(fs: pafs.FileSystem, path: str, data: bytes | list) -> None:
    """Writes the parts under another name first: readers see whole files only."""
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    fs.move(temp, path)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", dtype: str | None = None) -> tuple[str, DataFrame]:
    """Writes the files; returns the folder and a row per document in it: file, place, doc_id, n."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = texts.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    out = pa.schema([("file", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        code = encoder(vocabulary, dtype)
        end, width = np.array([end_id], code.dtype).tobytes(), code.dtype.itemsize
        k, place, ends = TaskContext.get().partitionId(), 0, [0]
        temp, sink = f"{path}/ids-{k:06d}.bin.{uuid.uuid4().hex}", None
        for part in slices(batches):
            sink = sink or fs.open_output_stream(temp)
            data = [x + end for x in code.ids(part.column("text").to_pylist())]
            sink.write(b"".join(data))
            sizes = [len(x) // width for x in data]
            ends += (ends[-1] + np.cumsum(sizes)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(data), pa.int32()), pa.array(range(place, place + len(data)), pa.int64()), part.column("doc_id"), pa.array(sizes, pa.int64())], schema=out)
            place += len(data)
        if sink:
            sink.close()
            fs.move(temp, f"{path}/ids-{k:06d}.bin")
            write_whole(fs, f"{path}/ids-{k:06d}.off", np.array(ends, "<i8").tobytes())

    return folder, stored(dealt.mapInArrow(write, "file int, place bigint, doc_id bigint, n bigint"), "token-rows")


def bases(rows: DataFrame) -> DataFrame:
    """file and the ids before it: prefix sums of the totals, one row a file."""
    totals = rows.groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect()  # one number a file
    starts = np.concatenate(([0], np.cumsum([r["n"] for r in totals]))).tolist()
    return rows.sparkSession.createDataFrame([(r["file"], int(s)) for r, s in zip(totals, starts)], "file int, base bigint")


def open_ids(folder: str, k: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents first to last of a file, and where each starts among them (then the total): memory-mapped
    where the folder is mounted, else those parts of the files are read. The width of an id is the file's size over its total."""
    fs, path = filesystem(folder)
    ids, off = f"{path}/ids-{k:06d}.bin", f"{path}/ids-{k:06d}.off"
    sizes = [i.size for i in fs.get_file_info([ids, off])]
    last = sizes[1] // 8 - 2 if last is None else last

    def part(name: str, dtype: str, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.empty(0, dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(name, dtype, "r")[a:b]
        with fs.open_input_file(name) as f:
            width = np.dtype(dtype).itemsize
            return np.frombuffer(f.read_at((b - a) * width, a * width), dtype)

    total = int(part(off, "<i8", sizes[1] // 8 - 1, sizes[1] // 8)[0])
    starts = part(off, "<i8", first, last + 2)
    return part(ids, f"<u{sizes[0] // total if total else 2}", int(starts[0]), int(starts[-1])), np.asarray(starts) - starts[0]


def read_token_files(folder: str, rows: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = rows.sparkSession
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")  # a row for 4096 documents
    spans = rows.groupBy("file", F.floor(F.col("place") / 4096).alias("part")).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.sum("n").alias("n")).withColumn("before", before)
    spans = spans.join(F.broadcast(bases(rows)), "file").select("file", "part", "a", "b", (F.col("base") + F.col("before")).alias("base"))
    out = pa.schema([("file", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a, b, base in zip(*(batch.column(c).to_pylist() for c in ("file", "a", "b", "base"))):
                ids, starts = open_ids(folder, k, a, b)
                at = starts.tolist()
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at, at[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(a, a + n), pa.int64()), pa.array([base + i for i in at[:-1]], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], schema=out)

    found = spans.repartition("file", "part").mapInArrow(read, "file int, place bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(rows.select("file", "place", "doc_id"), ["file", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")
