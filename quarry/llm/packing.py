"""Best-fit packing of tokenised documents into sequences: hierarchical residual packing.

Documents are tokenised in a narrow map; only ones longer than the capacity are cut, into pieces of
the capacity, the last one shorter. Pieces of full length are sequences of their own. The others
are packed best-fit by descending length inside each partition; bins with at most `slack` tokens
free are emitted, and each underfull bin goes up as one item of its length. A round deals the
remaining bins to a fraction of the tasks and packs again, until one task holds them all or a round
merges nothing. A task never takes more than `task_items` bins, so the last rounds stay bounded at
every input size. Bin contents are kept as a parent table (bin -> bin, offset) and resolved by one
join a round; token ids never move.

Defined cases: null text counts as empty, an empty text gives the end id alone; repeated doc_ids are
separate documents; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, stored
from quarry.llm.tokens import KEPT_WORDS, encoder

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (of unsigned little-endian 32-bit ids), and ids (those bytes) if asked for."""
    schema = _PIECES + (", ids binary" if with_ids else "")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary, kept_words=kept_words), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(batch.column(0).to_pylist(), code.ids(batch.column(1).to_pylist())):
                data = np.frombuffer(raw, code.dtype).astype("<u4").tobytes() + end
                for i, a in enumerate(range(0, len(data), 4 * capacity)):
                    ids = data[a : a + 4 * capacity]
                    for column, x in zip(rows, (doc, i, a // 4, len(ids) // 4, zlib.crc32(ids), ids)):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return texts.mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, best-fit by descending length: each goes into the fullest bin that takes it.

    Bins are kept by free space, so a step costs a search among at most `capacity` values."""
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    by_free: dict[int, list[int]] = {}
    frees: list[int] = []  # the distinct ones, sorted
    n = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        at = bisect_left(frees, size)
        if at < len(frees):
            free = frees[at]
            b = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], frees[at]
        else:
            free, b, n = capacity, n, n + 1
        place[i] = (b, capacity - free)
        left = free - size
        if left:
            if left in by_free:
                by_free[left].append(b)
            else:
                by_free[left] = [b]
                insort(frees, left)
    return place


def pack(items: DataFrame, capacity: int = 2048, slack: int = 4, fan_in: int = 4, task_items: int = 50_000) -> DataFrame:
    """items (key, length) -> key, sequence_id, offset. key must tell the rows apart; lengths are 1 to capacity."""
    spark = items.sparkSession
    whole = items.where(F.col("length") >= capacity)
    rest = items.where(F.col("length") < capacity).select("key", "length")
    top: list[DataFrame] = []  # of each round: item -> bin, offset
    first, r, before = rest, 0, None
    level = rest
    while True:
        tag = r

        def one_task(batches: Iterator[pa.RecordBatch], tag=tag) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            held = [(b.column("key").to_numpy(), b.column("length").to_numpy()) for b in batches]
            if not held:
                return
            keys, lengths = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]).tolist()
            for a in range(0, len(keys), task_items):
                place = best_fit(lengths[a : a + task_items], capacity)
                if not place:
                    continue
                bins = np.array([b for b, _ in place], "int64")
                used = np.bincount(bins, lengths[a : a + task_items]).astype("int64")
                name = (np.int64(tag) << 58) | (np.int64(part) << 36) | (bins + a)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + task_items]), pa.array(name), pa.array([o for _, o in place], pa.int64()), pa.array(used[bins])], names=["key", "bin", "offset", "used"])

        placed = stored(level.mapInArrow(one_task, "key bigint, bin bigint, offset bigint, used bigint"), f"pack-{r}")
        top.append(placed)
        under = placed.where((F.col("offset") == 0) & (F.col("used") < capacity - slack)).select(F.col("bin").alias("key"), F.col("used").alias("length"))
        n, tasks = under.count(), placed.rdd.getNumPartitions() if before is None else parts
        parts = max(1, -(-n // task_items), tasks // fan_in)
        if n < 2 or (before is not None and (n >= 0.999 * before[0] and before[1] == parts or before[1] == 1)):
            break
        before = (n, parts)
        level = under.repartition(parts, F.xxhash64("key", F.lit(r)))
        r += 1
    out = top[-1].select("key", F.col("bin").alias("sequence_id"), "offset")
    for lower in reversed(top[:-1]):
        up = out.select(F.col("key").alias("b"), F.col("sequence_id").alias("s"), F.col("offset").alias("o"))
        out = lower.join(up, F.col("bin") == F.col("b"), "left").select("key", F.coalesce("s", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"))
    return whole.select("key", (F.col("key") - F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(out)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. kept_words: whose ids a worker keeps."""
    pieces = token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col, kept_words=kept_words).withColumn("key", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    placed = pack(pieces.select("key", "length"), capacity)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
