"""Line dedup: repeated and nearly repeated lines, by a segment-partition edit join.

Lines (lower-cased, runs of white space made one space, ends trimmed) within `distance` edits of one another
share one of `distance + 1` segments of the shorter one, at a place near its own. Each line puts its
segments into an index keyed by length, segment number and content, and probes the index of each
length that is at most `distance` smaller with its substrings at the places a match can have.
Equal keys make buckets of line ids (hashes of the normalised lines, so equal lines are one id);
members of a bucket are verified with a banded bit-parallel edit distance, behind a filter on letter
counts. Linked lines form classes, and of each class the first line, by (doc_id, place), stays.

One pass over the texts writes a narrow row per line: its place, its id and its keys, which are hashes of
substrings taken for many lines at once from running sums. Buckets are found by an aggregation with
map-side combine. Texts are looked up for the members of buckets alone, and a document's lines are
joined once, with the places of those that go.

Defined cases: null text has no lines; lines of fewer than `min_chars` characters after normalisation
(blank ones too) are left alone, because such lines ("yes", "}", "* * *") repeat in unrelated
documents and two edits can make most of them equal; rows with equal doc_ids are told apart by their texts, and
rows equal in both are treated alike, as one document; a null doc_id comes first; an empty table gives an empty
result; extra columns are kept by drop_lines() and ignored by line_report().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.cluster import BROADCAST_IDS, LIMIT, bucket_sizes, classes, in_order, one_of_equals, spanning_links, sub_buckets
from quarry.llm.common import drop_stored, join_frequent, slices, stored
from quarry.llm.tokens import encoder

MIN_CHARS = 12
#: Lines whose keys are made at once: their running sums stay in a processor's cache.
_LINES = 2000
#: Ids of lines that a task remembers; lines met again have no keys of their own.
_SEEN = 200_000
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0x94D049BB133111EB)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (fixed multipliers of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """Index and probe keys of many lines at once.

    A substring's hash is a difference of running sums of characters times powers of an odd base, modulo 2^64. Keys
    only propose: a chance collision costs a comparison and never makes a link.
    """

    def __init__(self, distance: int):
        self.distance, self.parts = distance, distance + 1
        # (how much shorter the index line is, segment, shift of its place); the line's own segments come first
        self.ways = [(0, i, 0) for i in range(self.parts)]
        for gap in range(distance + 1):
            for i in range(self.parts):
                # a match may lie where neither the edits before it nor those after it exceed the distance
                shifts = range(max(-i, gap - (distance - i)), min(i, gap + distance - i) + 1)
                self.ways += [(gap, i, s) for s in shifts if (gap, s) != (0, 0)]
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        self.up, self.down = np.full(n, _BASE, "uint64"), np.full(n, pow(_BASE, -1, 2**64), "uint64")
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def segments(self, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(start, length) of the even segments of each length, shorter ones first."""
        short, longer = np.divmod(length, self.parts)
        first = self.parts - longer
        return [(i * short + np.maximum(0, i - first), short + (i >= first)) for i in range(self.parts)]

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys (lines x ways) and which of them count; the first `parts` ways are the index."""
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "uint32")
        if len(chars) > len(self.up):
            self._powers(1 << len(chars).bit_length())
        total = np.zeros(len(chars) + 1, "uint64")
        np.cumsum(chars * self.up[: len(chars)], out=total[1:])
        n = np.fromiter(map(len, lines), "int64", len(lines))
        at = np.cumsum(n) - n
        out, use = np.empty((len(lines), len(self.ways)), "uint64"), np.empty((len(lines), len(self.ways)), bool)
        cut = [self.segments(n - gap) for gap in range(self.distance + 1)]
        for c, (gap, i, shift) in enumerate(self.ways):
            start, size = cut[gap][i]
            start = start + shift
            ok = (start >= 0) & (start + size <= n) & (n - gap >= self.parts)
            a, size = at + np.where(ok, start, 0), np.where(ok, size, 0)
            # the last character's power is within the table: an empty substring at the very end counts as none
            h = (total[a + size] - total[a]) * self.down[np.minimum(a, len(self.down) - 1)]
            out[:, c] = mix(h + ((n - gap) * 64 + i).astype("uint64") * _STEP)
            use[:, c] = ok & (out[:, c] != out[:, i]) if gap == 0 and shift else ok  # a probe that equals the line's own index key
        return out, use


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k (under 31): bit-parallel columns kept to the diagonal band, as in H. Hyyro,
    "A bit-vector algorithm for computing Levenshtein and Damerau edit distances" (2003)."""
    if abs(len(a) - len(b)) > k:
        return False
    i, j = 0, min(len(a), len(b))
    while i < j and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i, j = 0, min(len(a), len(b))
    while i < j and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return len(a) + len(b) <= k
    if len(a) <= k or len(b) <= k:
        return _plain(a, b) <= k
    full, top = (1 << 64) - 1, 1 << 63
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    plus, minus, score = full & ~((1 << (63 - k)) - 1), 0, k
    shift, edge = k + 1 - 64, top >> 1
    for j, ch in enumerate(b):
        x = at.get(ch, 0)
        x = (x >> shift if shift >= 0 else x << -shift) & full
        shift += 1
        d = ((((x & plus) + plus) ^ plus) | x | minus) & full
        hp, hn = minus | ~(d | plus) & full, d & plus
        if j < len(a) - k:
            score += not d & top
        else:
            score += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        plus, minus = hn | ~((d >> 1) | hp) & full, (d >> 1) & hp
        if score > 2 * k + 1:
            return False
    return score <= k


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close_lines(rows: dict[str, list], forest, distance: int) -> Iterator[tuple[int, int]]:
    """Pairs of a sub-bucket within the distance and not yet joined; each edit changes two letter counts at most."""
    lines = rows["line"]
    size = np.array([len(s) for s in lines])
    if len(lines) > 8:
        count = np.zeros((len(lines), 32), "int16")
        for c, s in zip(count, lines):
            raw = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "uint32") & 31
            c += np.bincount(raw, minlength=32).astype("int16")
    side, cross = np.array(rows["side"]), rows["lo"][0] != rows["hi"][0]
    for i in range(len(lines) - 1):
        rest = forest.others(i)
        rest = rest[np.abs(size[rest] - size[i]) <= distance]
        if cross:
            rest = rest[side[rest] != side[i]]
        if len(lines) > 8:
            rest = rest[np.abs(count[rest] - count[i]).sum(1) <= 2 * distance]
        for j in rest.tolist():
            if forest.apart(i, j) and within(lines[i], lines[j], distance):
                yield i, j


def _lines(docs: DataFrame, distance: int, min_chars: int) -> DataFrame:
    """doc, mark, place, id and keys of each line of docs (doc, mark, text) that is long enough: the first distance + 1 keys are
    the index, the others probe. A line that the task has met before has none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker that encoded texts before lets its words go
        keys, seen = Keys(distance), set()
        for batch in slices(batches):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            new: list[str] = []
            counts: list[int] = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text"))):
                for place, raw in enumerate(text.lower().split("\n") if text else ()):
                    line = " ".join(raw.split())
                    if len(line) < min_chars:
                        continue
                    i = line_id(line)
                    for column, x in zip(rows, (doc, mark, place, i)):
                        column.append(x)
                    counts.append(i not in seen)
                    if i not in seen:
                        seen.add(i)
                        new.append(line)
            values, sizes = [], np.array(counts, "int64")
            for a in range(0, len(new), _LINES):
                k, use = keys(new[a : a + _LINES])
                values.append(k[use].view("int64"))
                sizes[np.flatnonzero(np.array(counts))[a : a + _LINES]] = use.sum(1)
            if len(seen) > _SEEN:
                seen.clear()
            ends = np.concatenate(([0], np.cumsum(sizes))).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, "int64")))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds)), lists], names=["doc", "mark", "place", "id", "keys"])

    return docs.mapInArrow(task, "doc bigint, mark bigint, place int, id bigint, keys array<bigint>")


def _line_texts(docs: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line of the given ids: each from its first place, so a document is read only where one of them begins."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = lines.join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "mark", "place")).alias("f"))
    wanted = wanted.groupBy(F.col("f.doc").alias("d"), F.col("f.mark").alias("m")).agg(F.collect_list("f.place").alias("places"), F.collect_list("id").alias("ids"))
    here = docs.join(F.broadcast(wanted) if few else wanted, (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, out = [], []
            for text, places, own in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "ids"))):
                parts = text.lower().split("\n")
                out += [" ".join(parts[p].split()) for p in places]
                names += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.string())], names=["id", "line"])

    return here.select("text", "places", "ids").mapInArrow(task, "id bigint, line string").dropDuplicates(["id"])


def line_classes(docs: DataFrame, lines: DataFrame, distance: int, limit: int = LIMIT) -> DataFrame:
    """id, root of the distinct lines that have a close one. docs: (doc, mark, text); lines: of _lines()."""
    pairs = lines.select("id", F.posexplode("keys").alias("way", "bucket"))
    index = F.col("way") <= distance
    # the sign tells index from probe: a bucket counts if some row of it is of the index and two lines differ
    signed = F.when(index, F.col("id").bitwiseAND(F.lit(2**63 - 1))).otherwise(F.col("id").bitwiseOR(F.lit(-(2**63))))
    met = pairs.groupBy("bucket").agg(F.min(signed).alias("least"), F.max(signed).alias("most")).where("most >= 0 AND least != most").select("bucket")
    met = stored(met, "line-keys-met")
    few = met.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = stored(pairs.join(F.broadcast(met) if few else met, "bucket", "left_semi").select("bucket", "id").distinct(), "line-buckets")
    drop_stored(met)
    subs = stored(sub_buckets(rows, one_of_equals(bucket_sizes(rows)), limit), "line-sub-buckets")
    drop_stored(rows)
    texts = _line_texts(docs, lines, subs.select("id").distinct())
    found = classes(spanning_links(in_order(subs, texts), lambda rows, forest: close_lines(rows, forest, distance)))
    drop_stored(subs)
    return found


def repeated_places(docs: DataFrame, distance: int = 2, min_chars: int = MIN_CHARS, limit: int = LIMIT) -> DataFrame:
    """doc, mark, places, near: for each document with lines that go, their places and how many of them are not equal to
    the line that stays. docs: (doc, mark, text), of which doc and mark tell texts apart and order them."""
    lines = stored(_lines(docs, distance, min_chars), "lines")
    roots = line_classes(docs, lines, distance, limit)
    named = lines.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "place")).alias("first")).join(roots.select("id", "root"), "id", "left")
    named = stored(named.select("id", "n", "first", F.coalesce("root", "id").alias("root")), "line-names")
    drop_stored(roots)
    whole = named.groupBy("root").agg(F.sum("n").alias("all"), F.count("*").alias("ids"), F.min(F.struct("first", "id")).alias("best")).where(F.col("all") > 1)
    stays = join_frequent(named, stored(whole, "line-classes"), "root", "ids", ["id"], "inner")
    stays = stored(stays.select("id", "n", F.col("best.first").alias("stay"), (F.col("best.id") != F.col("id")).alias("near")), "lines-that-stay")
    gone = join_frequent(lines.select("doc", "mark", "place", "id"), stays, "id", "n", ["doc", "place"], "inner").where(F.struct("doc", "mark", "place") != F.col("stay"))
    return gone.groupBy("doc", "mark").agg(F.collect_set("place").alias("places"), F.size(F.collect_set(F.when(F.col("near"), F.col("place")))).cast("long").alias("near"))


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (a null doc_id comes first), mark (of the text) and text."""
    return docs.select(_doc(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))


#: A character that isn't white space.
_SOLID = r"(?U)[^\s\x1c-\x1f]"


def _with_kept(docs: DataFrame, gone: DataFrame, doc: Column, mark: Column, text: Column) -> DataFrame:
    """docs with _places, _near, _lines (of the text) and _kept (the lines that stay, null where all do). Lines are split before
    the join, so that they are a column there, and picked by position: the work is linear in their number."""
    base = docs.select("*", doc.alias("_doc"), mark.alias("_mark"), F.split(text, "\n").alias("_lines"))
    far = gone.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"), F.col("places").alias("_places"), F.col("near").alias("_near"))
    both = base.join(far, (F.col("_doc") == F.col("_d")) & (F.col("_mark") == F.col("_m")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    return both.withColumn("_kept", F.when(F.col("_places").isNotNull(), F.transform(left, lambda i: F.get("_lines", i))))


def line_report(docs: DataFrame, distance: int = 2, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_lines (that aren't blank), n_gone, n_near (of those, nearly equal ones) and text without
    them (null where the document had lines and nothing but white space is left)."""
    base = _ordered(docs, id_col, text_col)
    both = _with_kept(base.select("doc", "mark", F.col("text").alias("_text")), repeated_places(base, distance, min_chars), F.col("doc"), F.col("mark"), F.col("_text")).drop("_text")
    none, kept = F.lit(0).cast("long"), F.array_join("_kept", "\n")
    return both.select(
        F.nullif("doc", F.lit(-(2**63))).alias("doc_id"),
        F.size(F.filter(F.coalesce("_lines", F.array()), lambda x: x.rlike(_SOLID))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_places").cast("long"), none).alias("n_gone"),
        F.coalesce("_near", none).alias("n_near"),
        F.when(F.col("_places").isNull(), F.array_join("_lines", "\n")).when(kept.rlike(_SOLID), kept).alias("text"),
    )


def drop_lines(docs: DataFrame, distance: int = 2, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without repeated lines; documents of which nothing but white space is left go. chars_col, if there, is counted again."""
    gone = repeated_places(_ordered(docs, id_col, text_col), distance, min_chars)
    out = _with_kept(docs, gone, _doc(id_col), F.xxhash64(text_col), F.col(text_col).cast("string"))
    kept, same = F.array_join("_kept", "\n"), F.col("_places").isNull()
    out = out.where(same | kept.rlike(_SOLID)).withColumn(text_col, F.when(same, F.array_join("_lines", "\n")).otherwise(kept))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(same, F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)
