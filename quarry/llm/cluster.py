"""Buckets of candidates, and classes of linked ids: what the two near-duplicate operators share.

Rows (bucket, id) are pruned to buckets of two or more; buckets with the same members are
looked at once. A bucket of more than `limit` members is cut into blocks by id hash and each pair of
blocks becomes a sub-bucket, so no task meets more than `limit` members of a bucket at once and no
pair is lost. Pairs are compared inside tasks and never emitted as rows: a sub-bucket yields verified
links that span its linked members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, join_frequent, stored

#: Members that a task compares with one another at once.
LIMIT = 1000
#: Ids up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 500_000


def bucket_sizes(rows: DataFrame, *keep: str) -> DataFrame:
    """bucket, n, mark (of its members) and the columns to keep, of buckets with two or more members."""
    return rows.groupBy("bucket", *keep).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark")).where("n > 1")


def one_of_equals(sizes: DataFrame) -> DataFrame:
    """One bucket of those with the same members."""
    return sizes.groupBy("n", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n")


def sub_buckets(rows: DataFrame, sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """bucket, lo, hi, side, id: side is 1 for members of block hi, where lo and hi differ."""
    sizes = stored(sizes.select("bucket", "n"), "bucket-sizes")  # read twice below
    blocks = F.ceil(F.col("n") / (limit // 2)).cast("int")
    own = F.when(F.col("n") <= limit, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int"))
    other = F.explode(F.when(F.col("n") <= limit, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    met = join_frequent(rows.select("bucket", "id"), sizes, "bucket", "n", ["id"], "inner").select("bucket", "id", own.alias("own"), other.alias("other"))
    return met.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id")


def look_up(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of table (id, ...) for the given ids, one for each."""
    ids = ids.select("id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return table.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])


def in_order(subs: DataFrame, payload: DataFrame) -> DataFrame:
    """Members of each sub-bucket with their payload, side by side in one task."""
    first = ("bucket", "lo", "hi", "side", "id")
    return subs.join(payload, "id").select(*first, *[c for c in payload.columns if c != "id"]).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "side", "id")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, list]]:
    """Rows of each run of equal first `keys` columns, as lists by name."""
    key, rows = None, None
    for batch in batches:
        names, columns = batch.schema.names, [c.to_pylist() for c in batch.columns]
        marks = list(zip(*columns[:keys]))
        i = 0
        while i < len(marks):
            j = i
            while j < len(marks) and marks[j] == marks[i]:
                j += 1
            if marks[i] != key:
                if rows:
                    yield rows
                key, rows = marks[i], {n: [] for n in names}
            for n, c in zip(names, columns):
                rows[n] += c[i:j]
            i = j
    if rows:
        yield rows


class Forest:
    """Which members are joined so far: label holds the first member of each one's component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def others(self, i: int) -> np.ndarray:
        """Members after i that aren't joined with it."""
        return np.flatnonzero(self.label[i + 1 :] != self.label[i]) + i + 1

    def apart(self, i: int, j: int) -> bool:
        return self.label[i] != self.label[j]

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]))
        self.label[self.label == b] = a


def spanning_links(members: DataFrame, compare: Callable[[dict[str, list], Forest], Iterator[tuple[int, int]]]) -> DataFrame:
    """a, b: links from each member of a sub-bucket to the first of those that it is linked with there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for rows in runs(batches, 3):
            forest = Forest(len(rows["id"]))
            for i, j in compare(rows, forest):
                forest.join(i, j)
            ids = rows["id"]
            for i, first in enumerate(forest.label.tolist()):
                if first != i:
                    a.append(ids[first])
                    b.append(ids[i])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return members.mapInArrow(task, "a bigint, b bigint")


def classes(links: DataFrame) -> DataFrame:
    """id, root (stored): the least id that links lead to. Least labels spread along links and through their own labels, so
    a few rounds are enough; each is an aggregation with map-side combine, written to the shared folder."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "classes")
    while True:
        near = both.join(now, F.col("b") == F.col("id")).groupBy(F.col("a").alias("k")).agg(F.min("root").alias("r"))
        moved = now.join(near, F.col("id") == F.col("k")).select("id", "root", F.least("root", "r").alias("next"))
        jump = now.select(F.col("id").alias("j"), F.col("root").alias("jr"))
        after = moved.join(jump, F.col("next") == F.col("j"), "left").select("id", F.least("next", F.coalesce("jr", "next")).alias("root"), (F.least("next", F.coalesce("jr", "next")) != F.col("root")).alias("changed"))
        step = stored(after, "classes")
        drop_stored(now)
        now = step
        if now.where("changed").isEmpty():
            drop_stored(both)
            return now
