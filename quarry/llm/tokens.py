"""Token ids of whole texts, by the tokenizers library, with ids of repeated words kept.

Both vocabularies split a text before their merges, and no piece crosses a single space or line
feed between two other characters. So a text is cut there, words seen before are looked up, and
the library encodes the others, many in one call with a separator of one known id between them.
A word of Latin letters is one piece, so it goes straight to the library's merges.
Texts with any other white space, or with the string of a special token, go to the library as they are.
The tokenizer is used as its file describes it: the string of a special token in a text becomes that token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, about 200 bytes each. When it has met half as many since the last time, those not met since then go.
KEPT_WORDS = 1_500_000
#: Words in a text for the library.
TEXT_WORDS = 100
#: Characters whose words are held at once: about 20 bytes each.
GROUP_CHARS = 2_000_000

#: Letters below U+0250 that normal forms leave alone and whose small form is one letter (U+0130's is not).
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_ALL_LATIN = re.compile(f"[{_LATIN}]+")
#: A line of such letters and the signs after them (no apostrophe, which may begin a piece with letters), or any other: both vocabularies split between the two.
_LETTERS = re.compile(rf"([{_LATIN}]++)([!-&(-/:-@\[-`{{-~]*+)\n|([^\n]++)\n")

#: The characters that stand for the 256 bytes in both vocabularies.
_PRINTED = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_PRINTED |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _printed(text: str) -> str:
    return text.encode().decode("latin-1").translate(_PRINTED)


class Encoder:
    """ids(texts): for each text the bytes of its ids, as little-endian numbers of the given type."""

    def __init__(self, path: str, dtype: str | None = None, kept_words: int = KEPT_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.kept_words = kept_words
        self.dtype = np.dtype(dtype or id_type(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        #: whether capitals are made small; then a word has the ids of its small letters
        self.folds = bool(self.tokenizer.normalizer) and self.tokenizer.normalizer.normalize_str("AÀŁ") == "aàł"
        self.feed = self._library("\n").tobytes()
        self.separator = "\n" if self.feed else " \x01 "
        self.mark = int(self._library(self.separator)[0])
        self.spaced: dict[str, bytes] = {}  # after a space
        self.first: dict[str, bytes] = {}  # at the start of a line
        self.older: dict[str, dict[str, bytes]] = {" ": {}, "": {}}  # what these two held before they started again
        self.merges = Tokenizer(self.tokenizer.model)  # the same merges, for pieces that are printed and cut already
        self.merges.pre_tokenizer = Split(_printed("\n"), "isolated")
        self.gap = {"": "", " ": "" if self._library(" a").tolist() == self._library("a").tolist() else _printed(" ")}
        probe = ["a", "the", "zephyrquoll", "àéübłong", "ŉßÿ", "ɏ", "ıǆƻǃ"]
        self.latin = True
        self.latin = all(self._each(probe, lead) == {w: self._library(lead + w).tobytes() for w in probe} for lead in self.gap)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, known: dict[str, bytes], words: Iterable[str], lead: str) -> None:
        """Adds the words to those known, but for empty ones and ones with white space inside."""
        older = self.older[lead]
        met = {w: older[w] for w in words if w in older} if older else {}
        known.update(met)
        new = [w for w in words if w not in met and w not in known]
        if "\n".join(new).split() != new:
            new = [w for w in new if w.split() == [w]]
        if not new:
            return
        cut = _LETTERS.split("\n".join(new) + "\n")  # letters and the signs after them are pieces of their own
        cores, tails, others = cut[1::4], cut[2::4], cut[3::4]
        if any(others):
            new, cores, tails = ([x for x, other in zip(xs, others) if not other] for xs in (new, cores, tails))
        if self.folds and cores:
            cores = "\n".join(cores).lower().split("\n")
        asked = set(cores).difference(known)
        met = {w: older[w] for w in asked if w in older} if older else {}
        known.update(met)
        for ask in ([w for w in asked if w not in met], [w for w in others if w]):
            if ask:
                known.update(self._each(ask, lead))
        ends = self._each([t for t in set(tails) if t], "") if any(tails) else {}
        ends[""] = b""
        known.update(zip(new, map(bytes.__add__, map(known.__getitem__, cores), map(ends.__getitem__, tails))))

    def _each(self, words: list[str], lead: str) -> dict[str, bytes]:
        """The ids of each word, after `lead`: some words make a text for the library, which takes short texts faster than long ones."""
        out: dict[str, bytes] = {}
        tool, mark, gap, glue, shown = self.tokenizer, self.mark, lead, self.separator + lead, words
        if self.latin and _ALL_LATIN.fullmatch("".join(words)):
            tool, gap = self.merges, self.gap[lead]
            mark, glue = tool.encode(_printed("\n")).ids[0], _printed("\n") + gap
            shown = [w if w.isascii() else _printed(w) for w in words]
        size = self.dtype.itemsize
        places = range(0, len(words), TEXT_WORDS)
        for i, found in zip(places, tool.encode_batch_fast([gap + glue.join(shown[i : i + TEXT_WORDS]) for i in places], add_special_tokens=False)):
            group, ids = words[i : i + TEXT_WORDS], np.array(found.ids, self.dtype)
            ends = (np.flatnonzero(ids == mark) * size).tolist() + [len(ids) * size]
            if len(ends) != len(group):  # some word holds the separator: each goes alone
                out.update((w, self._library(lead + w).tobytes()) for w in group)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(group, ends):
                out[w] = raw[start:end]
                start = end + size
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) > GROUP_CHARS:
                out += self._ids(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._ids(group) if group else out

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.first) > self.kept_words // 2:
            self.older = {" ": self.spaced, "": self.first}
            self.spaced, self.first = {}, {}
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        at, words = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False).astype("int64")
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
        fed = np.flatnonzero(pc.match_substring(words.dictionary, "\n").to_numpy(zero_copy_only=False)).tolist()
        lines = [distinct[i].split("\n") for i in fed]
        heads = [distinct[i].split("\n") for i in place[at[:-1]].tolist()]  # no space before them
        ids = list(map(self.spaced.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        self._learn(self.spaced, dict.fromkeys([w for i in new if "\n" not in (w := distinct[i])] + [ws[0] for ws in lines]), " ")
        self._learn(self.first, {w for ws in heads for w in ws} | {w for ws in lines for w in ws[1:]}, "")
        for i in new:
            ids[i] = self.spaced.get(distinct[i])
        for i, ws in zip(fed, lines):
            ids[i] = self._lines(ws, self.spaced)
        place[at[:-1]] = np.arange(len(ids), len(ids) + len(heads))
        ids += [self._lines(ws, self.first) for ws in heads]
        whole = np.array([self.special.search(t) is not None for t in texts], bool)
        if None in ids:  # white space at an end, doubled or of another kind
            whole |= np.logical_or.reduceat(np.array([x is None for x in ids])[place], at[:-1])
            ids = [x or b"" for x in ids]
        size = self.dtype.itemsize
        lengths = np.fromiter(map(len, ids), "int64", len(ids)) // size
        starts, n = np.cumsum(lengths) - lengths, lengths[place]
        ends = np.cumsum(n)
        take = np.repeat(starts[place] - (ends - n), n)
        take += np.arange(len(take))
        raw = np.frombuffer(b"".join(ids), self.dtype)[take].tobytes()
        bounds = (np.concatenate(([0], ends))[at] * size).tolist()
        return [self._library(t).tobytes() if w else raw[a:b] for t, w, a, b in zip(texts, whole.tolist(), bounds, bounds[1:])]

    def _lines(self, words: list[str], known: dict[str, bytes]) -> bytes | None:
        """The ids of words with line feeds between them, the first of which is looked up in `known`."""
        found = [known.get(words[0]), *map(self.first.get, words[1:])]
        return None if None in found else self.feed.join(found)


def id_type(vocabulary_size: int) -> str:
    """16-bit numbers where all ids fit, else 32-bit ones."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


@cache
def encoder(path: str, dtype: str | None = None, kept_words: int = KEPT_WORDS) -> Encoder:
    """One per worker, path, type and number of words kept."""
    return Encoder(path, dtype, kept_words)
