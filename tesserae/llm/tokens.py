"""Exact byte-pair encoding of whole corpora by prefix dynamic programming.

Greedy merging is replaced by a left-to-right dynamic programme. For a valid encoding every prefix
of a word has exactly one last token, and a token may follow another only if merging the two of
them alone would leave them apart. So for each end position the vocabulary entries that end there
(found by an Aho-Corasick automaton over the whole vocabulary) are tested against the stored last
token of the prefix before them; the single compatible one is stored, and the ids are read off by
following the stored tokens back from the end. Words recur, so each worker remembers the ids of
the words it has seen, within a memory bound that never changes a result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"

# The published splitting pattern, once for text of ASCII only and once in general.
# White space is Unicode's White_Space property, spelled out because the libraries differ about U+001C to U+001F.
_ASCII = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GENERAL = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Words longer than this are not remembered, and a worker forgets all words beyond this number.
MEMO_WORD, MEMO_WORDS = 48, 150_000


def _byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairEncoder:
    """One vocabulary of byte-level merges, ready to encode; build one per worker process."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        self._letters = {i: c for i, c in enumerate(letters)}
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Internal numbers follow the order of merging: single bytes first, then one number a merge.
        inner = {c: i for i, c in enumerate(letters)}
        self._left, self._right = list(range(256)), list(range(256))
        self._merged: dict[int, int] = {}
        for a, b in merges:
            a_, b_, n = inner[a], inner[b], len(self._left)
            inner.setdefault(a + b, n)
            self._merged.setdefault((a_ << 32) | b_, n)
            self._left.append(a_)
            self._right.append(b_)
        self._outer = [0] * len(self._left)
        self._length = [0] * len(self._left)
        self._automaton = ahocorasick.Automaton()
        for word, n in inner.items():
            self._outer[n], self._length[n] = vocab[word], len(word)
            self._automaton.add_word(word, n)
        self._automaton.make_automaton()
        self._split_ascii = re.compile(_ASCII).findall
        self._split = regex.compile(_GENERAL).findall
        self._apart: dict[int, bool] = {}
        self._ids = _Memo(self._encode_word)
        self._counts = _Memo(lambda w: len(self._ids[w]))

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging token a followed by token b leaves exactly these two tokens.

        The merges that build a and b are undone from the latest to the earliest; at each step the
        two tokens that meet at the seam must not merge before the step that was undone last.
        """
        limit, merged, left, right = 1 << 60, self._merged, self._left, self._right
        while True:
            if merged.get((a << 32) | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:  # a single byte: nothing is left to undo on this side
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _encode_word(self, word: str) -> tuple[int, ...]:
        s = word.encode("utf-8", "replace").decode("latin-1").translate(self._letters)
        last, apart, length = [-1] * len(s), self._apart, self._length
        for end, token in self._automaton.iter(s):
            if last[end] >= 0:
                continue
            start = end - length[token]  # index of the last letter before the token
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                pair = (before << 32) | token
                ok = apart.get(pair)
                if ok is None:
                    if len(apart) > 500_000:
                        apart.clear()
                    ok = apart[pair] = self._stay_apart(before, token)
                if not ok:
                    continue
            last[end] = token
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(self._outer[last[at]])
            at -= length[last[at]]
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        return (self._split_ascii if text.isascii() else self._split)(text)

    def encode(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self._ids.__getitem__, self.words(text)))

    def count(self, text: str) -> int:
        return sum(map(self._counts.__getitem__, self.words(text)))


class _Memo(dict):
    def __init__(self, make):
        self._make = make

    def __missing__(self, word: str):
        value = self._make(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


_encoders: dict[str, BytePairEncoder] = {}


def encoder(folder: str, name: str = BYTE_BPE) -> BytePairEncoder:
    path = os.path.join(folder, name)
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_column(df: DataFrame, id_column: str, text_column: str, *, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """``<id_column>, ids``: the token ids of each row's text, in order, without special tokens.

    Null and empty texts give an empty list. Text that looks like a special token is ordinary text.
    Each row is encoded by itself and whole, however long; repeated rows give repeated results, an
    empty table an empty one, and other columns never reach the worker.
    """
    ids = df.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            for part in slices(batch, 1):
                flat, offsets = array("i"), array("i", [0])
                for text in part.column(1).to_pylist():
                    if text:
                        flat.extend(enc.encode(text))
                    offsets.append(len(flat))
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                starts = pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(starts, values)], names=[id_column, "ids"])

    return ids.mapInArrow(run, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, ids array<int>")


def count_column(df: DataFrame, id_column: str, text_column: str, *, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """``<id_column>, n_tokens``: the number of ids that :func:`encode_column` gives, 0 for null and empty texts."""
    ids = df.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            n = array("q", [enc.count(t) if t else 0 for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.int64(), len(n), [None, pa.py_buffer(n)])], names=[id_column, "n_tokens"])

    return ids.mapInArrow(run, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, n_tokens long")


def slices(batch: pa.RecordBatch, text_at: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one piece hold about ``most`` bytes; one row is never cut."""
    import numpy as np

    column = batch.column(text_at)
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).cumsum() if len(column) else []
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
