"""Pages of repeated keywords, links or product tags instead of sentences.

A page's lines are set apart if they are technical (code, logs, traces, paths). All others are cut into
sentences and tokens (words, runs of marks, the beginnings of links). A suffix automaton over the page's
tokens gives its repeated maximal substrings, of which those of some length count, and with them the
characters that they cover. A sentence says something by its structure, in whatever language: it is closed
by a full stop or the like, has a few words, hardly a separator or link among them, and no word over and
over. A page is stuffed if enough of it is covered by repeats outside of such sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import slices

_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\u202a-\u202e]")
_LEET = str.maketrans("0134578", "oieastb")
# Scripts written without blanks: each letter is a token of its own.
_SOLID = "\u0e00-\u0e7f\u0e80-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_TOKEN = re.compile(r"https?://|www\.|\w+|[^\w\s]+")
_HAS_SOLID = re.compile(f"[{_SOLID}]")
_SOLID_TOKEN = re.compile(rf"https?://|www\.|[{_SOLID}]|[^\W{_SOLID}]+|[^\w\s]+")
_STOPS = ".!?\u3002\uff01\uff1f\u2026\u061f\u06d4\u0964\u104b\u17d4"
_SENTENCE = re.compile(rf"[^{_STOPS}]+(?:[{_STOPS}]+(?=[^\s{_STOPS}\u3040-\u9fff])[^{_STOPS}]*)*[{_STOPS}]*|[{_STOPS}]+")
_SEPARATORS = frozenset(",;:/|\u00b7\u2022#\uff0c\u3001\uff1b\uff1a\u060c") | {"https://", "http://", "www."}
_ENDS = tuple(_STOPS)
_CLOSERS = "\"'\u00bb\u201d\u2019)*_` "
_TECHNICAL = re.compile(
    r"\s*(?:at\s+\S.*:\d+\)?|File \".*\", line \d+|Traceback \(most|Caused by:|(?:[\w.]*(?:Error|Exception|Warning|panicked))\b.*:?"
    r"|[\[(]?\d{1,4}[-:/.]\d{1,2}[-:/.T]\d{1,4}\S*\s.*|.*\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b.*\d.*"
    r"|[-*+\s>|`]*(?:[\w.@~-]+/)+[\w.@-]*\.\w{1,10}`?(?:[:(]\d+\S*)?[\s,;]*|[-+]{3} \S+|@@ .*@@|diff --git .*|\$ \S.*|[MADRU?]{1,2}\s+\S+/\S+\s*)$"
)
_CODE_LETTERS = re.compile(r"[{}();=\[\]<>|&\\]")
_CODE_SHAPE = re.compile(r"[;{}(]\s*$|\)\s*[;:,{]?$|^\s*[})\]]|=>|\w\(.*\)|\w\s*=\s*\S")
#: A repeated substring counts from so many characters on, blanks between its tokens left out.
LEAST_SPAN = 5
#: Share of a page's characters that repeats outside of sentences must cover; less where it is strung phrases.
COVERED, STRUNG_COVERED = 0.3, 0.08
#: Share of a page that must not be said in sentences.
UNSAID = 0.55
#: Words that a page must have not to be a short text, and a sentence to say something.
LEAST_WORDS, LEAST_SAID = 12, 4
#: Phrases are strung if separators leave parts of at most so many words, and so many such parts.
STRUNG_WORDS, STRUNG_PARTS = 4, 8


def covered_tokens(tokens: list[str], least: int = LEAST_SPAN) -> list[bool]:
    """Which tokens lie in a substring of at least ``least`` characters that occurs at least twice.

    By the suffix automaton of the token sequence. Two neighbours that are such nowhere else end every repeated
    substring, so the automaton reads the runs of repeated neighbours with marks between them that nothing
    equals; a token without such neighbours is repeated by itself or not at all. This does not change the cover.
    """
    times = Counter(tokens)
    pairs = Counter(zip(tokens, tokens[1:]))
    linked = [pairs[p] > 1 for p in zip(tokens, tokens[1:])]
    covered = [times[t] > 1 and len(t) >= least for t in tokens]
    places: list[int] = []
    i, n = 0, len(linked)
    while i < n:
        if not linked[i]:
            i += 1
            continue
        j = i
        while j < n and linked[j]:
            j += 1
        if sum(map(len, tokens[i : j + 1])) >= least:
            places += range(i, j + 1)
            places.append(-1)
        i = j + 1
    if not places:
        return covered
    link, length, count, moves = [-1], [0], [0], [{}]
    ids: dict[str, int] = {}
    at, last, mark = [], 0, -1
    for place in places:
        if place < 0:
            t, mark = mark, mark - 1
        else:
            t = ids.setdefault(tokens[place], len(ids))
        new = len(link)
        length.append(length[last] + 1)
        count.append(1)
        moves.append({})
        p = last
        while p >= 0 and t not in (m := moves[p]):
            m[t] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = m[t]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                twin = new + 1
                link += (twin, link[q])
                length.append(length[p] + 1)
                count.append(0)
                moves.append(moves[q].copy())
                link[q] = twin
                while p >= 0 and moves[p].get(t) == q:
                    moves[p][t] = twin
                    p = link[p]
        last = new
        at.append(new)
    del moves
    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        count[link[v]] += count[v]
    # The longest repeated substring that ends at each place is maximal to the left; their union is the cover.
    sizes = [0, *accumulate(len(tokens[i]) if i >= 0 else 0 for i in places)]
    reach = len(places)
    for i in range(len(places) - 1, -1, -1):
        v = at[i]
        while v > 0 and count[v] < 2:
            v = link[v]
        begin = i - length[v] + 1
        if begin < reach and v > 0 and sizes[i + 1] - sizes[begin] >= least:
            reach = begin
        if reach <= i:
            covered[places[i]] = True
        else:
            reach = len(places)
    return covered


def plain(token: str) -> str:
    """A token with look-alike digits inside a word read as letters."""
    if token.isalpha() or token.isdigit() or not token[-1].isalnum():
        return token
    return token.translate(_LEET) if any(map(str.isalpha, token)) else token


def says_something(sentence: str, tokens: list[str]) -> bool:
    """Clause structure in any language: closed, enough words, few separators, and no word over and over."""
    if not sentence.rstrip(_CLOSERS).endswith(_ENDS):
        return False
    words = [t for t in tokens if t[0].isalpha()]
    # A letter of a script without blanks is half a word.
    n = len(words) - (0 if sentence.isascii() else 0.5 * sum(len(t) == 1 and t >= "\u0e00" for t in words))
    if n < LEAST_SAID or 4 * sum(map(_SEPARATORS.__contains__, tokens)) > n:
        return False
    long = [t for t in words if len(t) > 3]
    return len(set(long)) == len(long) or sum(k for k in Counter(long).values() if k > 1) <= 0.34 * len(long)


def is_strung(tokens: list[str]) -> bool:
    """Many short phrases with separators between them."""
    parts = words = 0
    for t in [*tokens, ","]:
        if t in _SEPARATORS:
            parts += 0 < words <= STRUNG_WORDS
            if words > 2 * STRUNG_WORDS:
                return False
            words = 0
        elif t[0].isalnum():
            words += 1
    return parts >= STRUNG_PARTS


def shares(text: str) -> tuple[float, float, float, int]:
    """``(unsaid, repeated, strung, words)``: shares of the page's characters outside of sentences and technical lines, those of them that repeats cover and those in strung phrases, and the number of words."""
    clean = text if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    technical, fenced = 0, False
    cut = _TOKEN if text.isascii() or not _HAS_SOLID.search(clean) else _SOLID_TOKEN
    tokens: list[str] = []
    sentences: list[tuple[str, int, int]] = []
    for line in clean.split("\n"):
        body = line.strip()
        if not body:
            continue
        if body.startswith(("```", "~~~")):
            fenced = not fenced
            technical += len(body)
        elif fenced or _TECHNICAL.match(body):
            technical += len(body)
        elif len(_CODE_LETTERS.findall(body)) > 0.05 * len(body) + 1 and _CODE_SHAPE.search(body) and not ("://" in body or "www." in body or "](" in body or "#" in body or "/" in body):
            technical += len(body)
        else:
            for sentence in _SENTENCE.findall(body):
                found = cut.findall(sentence.lower())
                if found:
                    sentences.append((sentence, len(tokens), len(tokens) + len(found)))
                    tokens += found
    size = sum(map(len, tokens))
    if not size or technical > size:
        return 0.0, 0.0, 0.0, 0
    covered = covered_tokens([t if t.isalpha() else plain(t) for t in tokens])
    upto = [0, *accumulate(map(len, tokens))]
    repeated_upto = [0, *accumulate(len(t) if c else 0 for t, c in zip(tokens, covered))]
    unsaid = repeated = strung = 0
    for sentence, a, b in sentences:
        if not says_something(sentence, tokens[a:b]):
            unsaid += upto[b] - upto[a]
            repeated += repeated_upto[b] - repeated_upto[a]
            if is_strung(tokens[a:b]):
                strung += upto[b] - upto[a]
    words = sum(t[0].isalnum() for t in tokens)
    total = size + technical
    return unsaid / total, repeated / total, strung / total, words


def is_stuffed(text: str) -> bool:
    """Whether the page is mostly keywords, links or tags; short and empty texts never are."""
    unsaid, repeated, strung, words = shares(text)
    if words < LEAST_WORDS or unsaid < UNSAID:
        return False
    return repeated >= (STRUNG_COVERED if strung >= UNSAID else COVERED)


def stuffed_pages(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``<id>`` of the rows whose text is stuffed, distinct.

    Every row is judged by itself on its whole text, whatever its language or source. Null, empty, blank
    and short texts are no cases; repeated texts are judged alike; no rows give no rows.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    df = documents.select(F.col(id_column), F.col(text_column).alias("_text")).where("_text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                bad = [i for i, t in enumerate(part.column(1).to_pylist()) if is_stuffed(t)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(bad, pa.int64()))], names=[id_column])

    return df.mapInArrow(run, f"`{id_column}` {kind}").distinct()
