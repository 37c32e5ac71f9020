"""Jaccard self-join on word shingles by chosen paths.

A document becomes the set of hashes of its runs of five words (words as in decontaminate; a document of
fewer words has one shingle of all of them). Equal sets count once. In each of several runs every set
chooses the shingles whose hash, seeded by the run, lies under a threshold of c over its size;
sets that chose the same shingle share a bucket. Buckets of up to a few times `limit` sets are compared by brute
force, in pairs of blocks of `limit`. Members of a larger bucket choose again in several runs, with hashes seeded by the path so far and
the run, and split into the buckets of the longer paths; where the members are so alike that most follow
the same paths, or at the last depth, the bucket is compared as it is, in pairs of blocks. Every
comparison ends in the exact Jaccard similarity of the sets of 32-bit shingle hashes; a sketch of 64 bytes a set sorts
out pairs before it, with a bar five standard deviations below the similarity asked for.

A pair of similarity s shares at least s * c chosen shingles a run in the mean, and the runs are
repeated until the chance to share none of them, on the first step or on any later one, is below
1 - recall in all. The runs of a later step reach that in each bucket alone, so large buckets of the same
members need only one of them. Linked sets form classes by connected components; inside a class all
links are counted exactly.

Defined cases: a null text or one without words is similar to nothing; an empty table gives an empty
result; near_duplicates() has a row for each row of its input, repeated ones too; near_copies() tells rows with equal
doc_ids apart by their texts, keeps one of rows that are equal in both, and takes a null doc_id as the smallest; extra columns
are kept by near_copies() and ignored by near_duplicates().
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.cluster import BROADCAST_IDS, bucket_sizes, classes, in_order, look_up, one_of_equals, runs, spanning_links, sub_buckets
from quarry.llm.common import drop_stored, join_frequent, slices, stored
from quarry.llm.decontaminate import words
from quarry.llm.line_dedup import mix as _mix

#: Sets compared with one another in a task: about 1.5 kB each. Fewer mean more blocks, whose pairs repeat the members of a large bucket.
COMPARED = 4000
#: Buckets of up to so many times that number are compared as they are, in blocks: it repeats their members less often than the paths
#: of a split would. Two blocks of COMPARED sets meet in a task.
WHOLE = 4
#: Sets of a class whose links are counted at once: a matrix of 16 MB, and one of 32 MB of the shingles that they have.
COUNTED = 2000
_SKETCH = 64
_KEPT_WORDS = 500_000


class Shingler:
    """Sorted distinct shingle hashes of a text; keeps the hashes of words it has seen."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = words(text)
        known = self.known
        if len(known) > _KEPT_WORDS:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(list(map(known.__getitem__, ws)), "uint64")
        k = min(self.size, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        s = np.full(n, k, "uint64")
        for i in range(k):
            s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        return np.unique(_mix(s))


def choose(tokens: np.ndarray, c: float, seed: int) -> np.ndarray:
    """Hashes, for the given seed, of the tokens that lie under c / n: the next steps of the set's paths."""
    h = _mix(tokens ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    bound = min(2**64 - 1, int(c / len(tokens) * 2.0**64))
    return h[h <= np.uint64(bound)]


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of the least token in each of 64 parts: parts agree about as often as the sets are similar."""
    part, low = (tokens >> np.uint64(58)).astype(int), (_mix(tokens) & np.uint64(0xFF)).astype("uint8")
    first = np.concatenate(([True], part[1:] != part[:-1]))
    out = np.zeros(_SKETCH, "uint8")
    filled = part[first]
    out[filled] = low[first]
    empty = np.setdiff1d(np.arange(_SKETCH), filled)
    at = np.searchsorted(filled, empty) % len(filled)  # an empty part takes what the next full one has
    out[empty] = out[filled[at]]
    return out.tobytes()


def runs_for(recall: float, similarity: float, c: float) -> int:
    return max(1, math.ceil(-math.log(1 - recall) / (similarity * c)))


def runs_by_depth(recall: float, similarity: float, c: float, depth: int) -> tuple[int, int]:
    """Runs on the first step and on each later one, in every large bucket: all misses together stay below 1 - recall."""
    first = runs_for(recall, similarity, c)
    spare = 1 - recall - math.exp(-similarity * c * first)
    if spare < (1 - recall) / 10:
        first += 1
        spare = 1 - recall - math.exp(-similarity * c * first)
    return first, runs_for(1 - spare / max(1, depth - 1), similarity, c)


def shingle_sets(docs: DataFrame, size: int, c: float, n_runs: int, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, id (of the set; null without words), paths, sketch, tokens (top 32 bits, sorted, as bytes) and the bigint columns to keep."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in slices(batches):
            rows: list[list] = [[] for _ in kinds]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = shingles(text)
                row = (doc, None, None, None, None)
                if len(t):
                    paths = np.unique(np.concatenate([choose(t, c, 0x51ED2701 * (r + 1)) for r in range(n_runs)]))
                    row = (doc, xxhash.xxh3_64_intdigest(t.tobytes()) - 2**63, paths.view("int64"), sketch(t), np.unique((t >> np.uint64(32)).astype("uint32")).tobytes())
                for column, x in zip(rows, row):
                    column.append(x)
            made = [pa.array(c, k) for c, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], names=["doc_id", "id", "paths", "sketch", "tokens", *keep])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return stored(texts.mapInArrow(task, "doc_id bigint, id bigint, paths array<bigint>, sketch binary, tokens binary" + "".join(f", {k} bigint" for k in keep)), "shingle-sets")


def _longer_paths(members: DataFrame, c: float, n_runs: int, step: int) -> DataFrame:
    """parent, bucket, id: the next steps, in n_runs runs, of the members (bucket, id, tokens) of large buckets."""
    seeds = [(step * 1024 + r) * 0x2545F4914F6CDD1D for r in range(n_runs)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            parent, child, ids = [], [], []
            for b, i, t in zip(*(batch.column(k).to_pylist() for k in ("bucket", "id", "tokens"))):
                tokens = np.frombuffer(t, "uint32").astype("uint64")
                nxt = np.unique(np.concatenate([choose(tokens, c, b ^ seed) for seed in seeds])).view("int64").tolist()
                parent += [b] * len(nxt)
                child += nxt
                ids += [i] * len(nxt)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (parent, child, ids)], names=["parent", "bucket", "id"])

    return members.select("bucket", "id", "tokens").mapInArrow(task, "parent bigint, bucket bigint, id bigint")


def similar_pairs(rows: dict[str, list], forest, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of a sub-bucket that are linked and not yet joined in the forest; sketches sort out most, tokens decide."""
    marks = np.frombuffer(b"".join(rows["sketch"]), "uint8").reshape(-1, _SKETCH)
    tokens = [np.frombuffer(t, "uint32") for t in rows["tokens"]]
    size, side = np.array([len(t) for t in tokens]), np.array(rows["side"])
    cross = rows["lo"][0] != rows["hi"][0]
    small, tiny = size < 4 * _SKETCH, size < _SKETCH  # sparse sketches say less, those with empty parts nothing sure
    need = similarity * _SKETCH - 5 * math.sqrt(_SKETCH * similarity * (1 - similarity))
    names, at = np.unique(np.concatenate(tokens), return_inverse=True)
    columns, mine = np.split(at, np.cumsum(size)[:-1]), np.zeros(len(names), "int32")
    for i in range(len(tokens) - 1):
        rest = forest.others(i)
        rest = rest[np.minimum(size[i], size[rest]) >= similarity * np.maximum(size[i], size[rest])]
        if cross:
            rest = rest[side[rest] != side[i]]
        bar = np.where(tiny[rest] | tiny[i], 0, np.where(small[rest] | small[i], need / 2, need))
        rest = rest[(marks[i] == marks[rest]).sum(1) >= bar]
        if not len(rest):
            continue
        mine[columns[i]] = 1
        starts = np.concatenate(([0], np.cumsum(size[rest])[:-1]))
        both = np.add.reduceat(mine[np.concatenate([columns[j] for j in rest.tolist()])], starts)
        mine[columns[i]] = 0
        for j in rest[both / (size[i] + size[rest] - both) >= similarity].tolist():
            if forest.apart(i, j):
                yield i, j


def link_counts(rows: dict[str, list], similarity: float) -> np.ndarray:
    """Of each member of a class's sub-bucket: the documents behind the other sets that it is linked with there."""
    tokens = [np.frombuffer(t, "uint32") for t in rows["tokens"]]
    n, copies, side = len(tokens), np.array(rows["copies"], "int64"), np.array(rows["side"])
    size = np.array([len(t) for t in tokens])
    names, at, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    owner, all_have = np.repeat(np.arange(n), size), often == n
    some = (often > 1) & ~all_have
    column = np.cumsum(some) - 1
    use = some[at]
    both = np.full((n, n), int(all_have.sum()), "float32")
    width = 4096
    for start in range(0, int(some.sum()), width):
        pick = use & (column[at] >= start) & (column[at] < start + width)
        has = np.zeros((n, width), "float32")
        has[owner[pick], column[at][pick] - start] = 1
        both += has @ has.T
    linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if rows["lo"][0] != rows["hi"][0]:
        linked &= side[:, None] != side[None, :]
    return linked @ copies


def set_classes(sets: DataFrame, similarity: float, c: float, limit: int, depth: int, recall: float = 0.9999) -> DataFrame:
    """id, root of the sets that are linked with any other one."""
    again = runs_by_depth(recall, similarity, c, depth)[1]
    payload = sets.where("id IS NOT NULL").select("id", "sketch", "tokens")
    once = sets.where("id IS NOT NULL").groupBy("id").agg(F.first("paths").alias("paths"))  # equal sets have equal paths
    rows = stored(once.select("id", F.explode("paths").alias("bucket")), "paths")
    sizes = bucket_sizes(rows)
    parts: list[DataFrame] = []
    used = [rows]
    for step in range(1, depth + 1):
        sizes = stored(sizes, "path-sizes")
        used.append(sizes)
        small = one_of_equals(sizes.where(F.col("n") <= limit))
        parts.append(sub_buckets(rows.select("bucket", "id"), small, limit))
        whole = one_of_equals(sizes.where((F.col("n") > limit) & (F.col("n") <= WHOLE * limit)))
        parts.append(sub_buckets(rows.select("bucket", "id"), whole, 2 * limit))
        large = one_of_equals(sizes.where(F.col("n") > WHOLE * limit))
        if step == depth or sizes.where(F.col("n") > WHOLE * limit).isEmpty():
            parts.append(sub_buckets(rows.select("bucket", "id"), large, 2 * limit))
            break
        members = stored(join_frequent(rows.select("bucket", "id"), stored(large, "large-sizes"), "bucket", "n", ["id"], "inner").select("bucket", "id", F.col("n").alias("members")), "large-buckets")
        longer = stored(_longer_paths(members.join(look_up(payload, members), "id"), c, again, step), "longer-paths")
        sizes_below = stored(bucket_sizes(longer, "parent"), "path-sizes")
        heads = members.select(F.col("bucket").alias("parent"), "members").distinct()
        mass = sizes_below.where(F.col("n") > WHOLE * limit).groupBy("parent").agg(F.sum("n").alias("below"))
        alike = stored(heads.join(mass, "parent").where(F.col("below") > 0.6 * c * again * F.col("members")).select(F.col("parent").alias("bucket"), F.col("members").alias("n")), "alike-buckets")
        parts.append(sub_buckets(members.select("bucket", "id"), alike, 2 * limit))
        split = longer.join(alike, F.col("parent") == alike["bucket"], "left_anti")
        rows = stored(split.select("bucket", "id").distinct(), "paths")
        used += [members, longer, sizes_below, alike, rows]
        sizes = bucket_sizes(rows)
    subs = parts[0]
    for p in parts[1:]:
        subs = subs.unionByName(p)
    subs = stored(subs, "sub-buckets")
    drop_stored(*used)
    members = in_order(subs, look_up(payload, subs))
    found = classes(spanning_links(members, lambda rows, forest: similar_pairs(rows, forest, similarity)))
    drop_stored(subs)
    return found


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.9999, c: float = 4.0, limit: int = COMPARED, count_limit: int = COUNTED, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (the least doc_id of its class), class_size, n_links (other
    documents that it is linked with)."""
    sets = shingle_sets(docs, size, c, runs_by_depth(recall, similarity, c, depth)[0], id_col, text_col)
    roots = set_classes(sets, similarity, c, limit, depth, recall)
    copies = stored(sets.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")), "set-copies")
    named = stored(copies.join(roots.select("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "set-classes")
    drop_stored(roots)

    class_sizes = named.groupBy(F.col("root").alias("bucket")).agg(F.count("*").alias("n"), F.sum("copies").alias("class_size"), F.min("first_doc").alias("class_id"))
    class_sizes = stored(class_sizes.where("n > 1"), "class-sizes")
    subs = stored(sub_buckets(named.select(F.col("root").alias("bucket"), "id"), class_sizes.select("bucket", "n"), count_limit), "class-blocks")
    payload = look_up(sets.where("id IS NOT NULL").select("id", "tokens"), subs).join(copies.select("id", "copies"), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array(link_counts(rows, similarity), pa.int64())], names=["id", "part"])

    linked = in_order(subs, payload).mapInArrow(count, "id bigint, part bigint").groupBy("id").agg(F.sum("part").alias("others"))
    by_set = (
        join_frequent(named.join(linked, "id", "left"), class_sizes.withColumnRenamed("bucket", "root"), "root", "n", ["id"])
        .select("id", "copies", F.coalesce("class_id", "first_doc").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    one = F.lit(1).cast("long")
    return join_frequent(sets.select("doc_id", "id"), stored(by_set, "set-links"), "id", "copies", ["doc_id"]).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", one).alias("class_size"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.9999, c: float = 4.0, limit: int = COMPARED, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: of each class the row of the least (doc_id, hash of text) stays, once."""
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(text_col)
    marked = docs.select(key.alias("doc"), mark.alias("mark"), F.col(text_col).alias("text"))
    sets = shingle_sets(marked, size, c, runs_by_depth(recall, similarity, c, depth)[0], "doc", "text", ["mark"])
    roots = set_classes(sets, similarity, c, limit, depth, recall)
    of_set = sets.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark")).alias("first")).join(roots.select("id", "root"), "id", "left")
    of_set = stored(of_set.select("id", "copies", "first", F.coalesce("root", "id").alias("root")), "set-firsts")
    of_class = stored(of_set.groupBy("root").agg(F.sum("copies").alias("rows"), F.count("*").alias("sets"), F.min("first").alias("stays")).where(F.col("rows") > 1), "class-firsts")
    stays = stored(join_frequent(of_set.select("id", "copies", "root"), of_class.select("root", "sets", "stays"), "root", "sets", ["id"], "inner").select("id", "copies", "stays"), "sets-that-stay")
    near = join_frequent(sets.select("doc_id", "mark", "id"), stays, "id", "copies", ["doc_id", "mark"], "inner")
    rows = near.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.count("*").alias("_times"), F.first(F.struct("doc_id", "mark") == F.col("stays")).alias("_stays"))
    marks = stored(rows.where("NOT _stays OR _times > 1"), "near-copies")
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = (key == F.col("_doc")) & (mark == F.col("_mark"))
    marks = F.broadcast(marks) if few else marks
    if marks.where("_stays").isEmpty():
        return docs.join(marks, met, "left_anti")
    both = docs.join(marks, met, "left")
    once = both.where("_stays").groupBy("_doc", "_mark").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))  # rows equal in id and text
    return both.where("_stays IS NULL").select(*docs.columns).unionByName(once.select("_row.*"))
