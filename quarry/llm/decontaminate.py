"""Benchmark decontamination with a generalised suffix automaton over item words.

Items are normalised to words (A-Z lower-cased; runs of letters, digits and anything beyond
ASCII) and put into a suffix automaton. Document words stream through it; at each
word the length of the longest matching suffix is known, so every occurrence of an item window is
found in one pass. Items are dealt into blocks of about `block_words` words; tasks build an automaton
of each and write it to the shared folder. One narrow map applies them: documents are never shuffled, nothing
is broadcast, and of many blocks a task holds one automaton at a time, for an Arrow batch of documents.

Defined cases: null text has no words; an item without words gives no window, one shorter than
the window is a window itself; a repeated item id counts once and a null one counts as an empty
string; empty tables give no hits; extra columns are carried through scan() and ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.cluster import runs
from quarry.llm.common import shared_dir
from quarry.llm.token_files import filesystem, write_whole

#: Item words in one automaton: about 300 bytes a word.
BLOCK_WORDS = 500_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, and what each state says about windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        seqs = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items if ws]
        self.shortest = min((min(len(s), window) for _, s in seqs), default=window)
        grams = set()
        for _, s in seqs:
            last = 0
            for w in s:
                last = self._extend(last, w)
            grams.update(a * len(self.vocab) + b for a, b in zip(s, s[1:]))
        self.grams = np.array(sorted(grams), "int64")
        self._annotate(seqs)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, {})
        while last != -1 and w not in nxt[last]:
            nxt[last][w] = cur
            last = link[last]
        if last == -1:
            link[cur] = 0
        else:
            q = nxt[last][w]
            link[cur] = q if length[q] == length[last] + 1 else self._clone(last, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _state(self, length: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _annotate(self, seqs: list[tuple[str, list[int]]]) -> None:
        """windows[v]: items with the window that ends every match of at least `window` words at v.
        short[v]: (words, item) of whole short items that are suffixes of v's longest string."""
        n, k = len(self.length), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        base = [0] * n  # the ancestor whose strings include the last k words
        for v in order:
            if self.length[v] >= k:
                base[v] = v if self.length[self.link[v]] < k else base[self.link[v]]
        items: dict[int, set] = {}
        own: dict[int, list] = {}
        for name, s in seqs:
            v = 0
            for i, w in enumerate(s, 1):
                v = self.next[v][w]
                if i >= k:
                    items.setdefault(base[v], set()).add(name)
            if len(s) < k:
                own.setdefault(v, []).append((len(s), name))
        self.windows = [items.get(base[v]) if base[v] else None for v in range(n)]
        self.short: list = [None] * n
        for v in order:
            self.short[v] = (own.get(v, []) + (self.short[self.link[v]] or [])) or None

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit spans (first word, last word + 1) and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(ws) < self.shortest or not self.vocab:
            return spans, found
        ids = np.array(list(map(self.vocab.get, ws, repeat(-1))), "int64")
        for a, b in self._runs(ids):
            self._walk(ids[a:b].tolist(), a, spans, found)
        return _union(spans), found

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches whose every adjacent word pair is in some item; no window lies outside of one."""
        if self.shortest < 2:
            good, more = ids >= 0, 0
        else:
            code = ids[:-1] * len(self.vocab) + ids[1:]
            at = np.searchsorted(self.grams, code)
            good = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.grams[np.minimum(at, len(self.grams) - 1)] == code) if len(self.grams) else np.zeros(len(code), bool)
            more = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype("int8")))
        return [(a, b + more) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b + more - a >= self.shortest]

    def _walk(self, ids: list[int], start: int, spans: list, found: set) -> None:
        v = size = 0
        for i, w in enumerate(ids, start + 1):
            while v and w not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                size += 1
            if size >= self.window:
                spans.append((i - size, i))
                found.update(self.windows[v] or ())
            for m, name in self.short[v] or ():
                if m <= size:
                    spans.append((i - m, i))
                    found.add(name)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[str]:
    """Files with an automaton each, in the shared folder. Items are dealt into blocks by their hash, so many that a block
    holds about block_words words; each block is built in a task of its own. An item's words are never split."""
    spark = items.sparkSession
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.regexp_count("text", F.lit(_WORD.pattern)).cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    folder = shared_dir(spark, "automata")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for rows in runs(batches, 1):
            k = rows["block"][0]
            auto = Automaton([(name, words(text)) for name, text in zip(rows["name"], rows["text"])], window)
            write_whole(fs, f"{path}/{k:06d}.pickle", pickle.dumps(auto, 5))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["block"])

    block = F.pmod(F.xxhash64("name", "text"), F.lit(n)).alias("block")
    dealt = named.select(block, "name", "text").distinct().repartition(n, "block").sortWithinPartitions("block")
    built = dealt.mapInArrow(build, "block bigint").collect()  # a number a block
    return [f"{folder}/{r['block']:06d}.pickle" for r in sorted(built)]


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, min_span: int | None = None) -> DataFrame:
    """docs with n_words, hit_spans (first word, last word + 1) and hit_items (sorted as strings).

    Columns of docs with these names are replaced. With min_span, the text loses its hit spans of at least that many words and
    those of whole items shorter than the window.
    """
    files = automata(items, item_col, item_text, window, block_words)
    base = docs.drop(*_FOUND.names)
    schema = T.StructType(list(base.schema.fields) + list(_FOUND.fields))
    text_at = base.columns.index(text_col)
    arrow = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[str, Automaton] | None = None  # one automaton at a time
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            found: list[set] = [set() for _ in range(batch.num_rows)]
            n = [0] * batch.num_rows
            for file in files:
                if kept is None or kept[0] != file:
                    kept = None
                    kept = (file, _load(file))
                for i, text in enumerate(batch.column(text_at)):
                    ws = words(text.as_py())
                    more, names = kept[1].match(ws)
                    n[i] = len(ws)
                    if more:
                        spans[i] = _union(spans[i] + more)
                        found[i] |= names
            if not files:
                n = [len(words(t.as_py())) for t in batch.column(text_at)]
            columns = list(batch.columns)
            if min_span is not None:
                cut = (cut_spans(t, s, min_span, window) for t, s in zip(batch.column(text_at), spans))
                columns[text_at] = pa.array(cut, batch.schema.field(text_at).type)
            made = [pa.array(x, k) for x, k in zip((n, spans, map(sorted, found)), arrow)]
            yield pa.RecordBatch.from_arrays(columns + made, names=[*batch.schema.names, *_FOUND.names])

    return base.mapInArrow(apply, schema)


def _load(file: str) -> Automaton:
    fs, path = filesystem(file)
    with fs.open_input_stream(path) as f:
        return pickle.loads(f.read())


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, window=window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: pa.StringScalar, spans: list[tuple[int, int]], min_span: int, window: int) -> str | None:
    """text without the words of the spans, and what stands between them, that have min_span words or, being whole short items,
    fewer than the window."""
    text = text.as_py()
    gone = [(a, b) for a, b in spans if b - a >= min_span or b - a < window]
    if not gone:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for a, b in gone:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join(out) + text[done:]


_LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 10, max_coverage: float = 0.5, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without contaminated text: hit spans of at least min_span words (or whole shorter items) go, and
    documents of whose words more than max_coverage are hit go as a whole. Other rows stay as they are;
    chars_col, if there, is counted again for changed texts."""
    named = docs.withColumnsRenamed({c: f"_kept_{c}" for c in docs.columns if c in _FOUND.names})  # columns that clash
    found = scan(named, items, text_col=text_col, window=window, min_span=min_span)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    out = found.where(hit <= F.lit(max_coverage) * F.col("n_words"))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.size("hit_spans") == 0, F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.drop(*_FOUND.names).withColumnsRenamed({f"_kept_{c}": c for c in docs.columns if c in _FOUND.names}).select(*docs.columns)
