"""Passages of held-out items in documents, whole or in part, with changed, missing or added words.

Method: q-gram lemma filtering.  Texts become streams of letters and digits (case, spacing, punctuation, markup,
escapes and invisible characters vanish), items one stream of question and answer each.  The q-grams of a
batch of documents are looked up in the items' q-grams; hits are counted per item in overlapping bands of
diagonals.  The lemma bounds what a passage within the edit budget keeps: each edited word destroys at most
``Q - 1`` q-grams and its own length of them, a cut at most ``Q - 1``.  The bound is computed for every place of an
item from the real lengths of the words there; pairs without a region that meets it are dropped.  What stays is chained into exact runs, and the words between
runs are aligned within a band to count what differs.  Nothing depends on what other items hold.

Scale: documents are read once per block of items and never shuffled before a match is found; a document or a
stretch of boilerplate that occurs often costs its own task only.  The items are the stated query set.  They are
read one block of at most ``BLOCK_CHARS`` characters at a time; a block is indexed once and its index, of bounded size,
goes to the tasks; further blocks are further passes, each written before the next is read.  Where boilerplate of all items
fills a document, its hits are expanded for a part of the items at a time.

Nulls: null ids are ignored; null or empty texts contain nothing.  Repeated rows give the pair once.  An item
found in both question and answer is one row.  Empty tables give an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.storage import Workspace

#: Length of a q-gram in bytes of the stream, and width of a diagonal band.
Q, BAND = 12, 32
#: A passage has this many words, of which one in so many may differ.
PASSAGE_WORDS, EDIT_SHARE = 20, 8
#: Words of the longest passage that the bound looks at.
LONGEST = 24
#: Exact runs further apart than this belong to different pieces; pieces with fewer exact words than this are no evidence.
GAP_BYTES, PIECE_WORDS = 96, 3
#: Words by which a piece is continued word for word at either end, where runs are too short for a q-gram.
REACH = 12
#: Most bytes of items in one block, of documents hashed at once, and of hits expanded at once.
BLOCK_CHARS, CHUNK, EXPANDED = 2_000_000, 1_000_000, 8_000_000
#: Most pairs of documents and items that are counted in one array.
COUNTED = 8_000_000

_LOWER = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*+(?:\s[^<>]*+)?/?>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[\da-fA-F]{1,6}|[A-Za-z]{2,10});")
_ESCAPE = re.compile(r"\\(?:u([\da-fA-F]{4})|x([\da-fA-F]{2})|[nrtbf0])")
_PERCENT = re.compile(r"(?:%[\da-fA-F]{2})+")
_NUMBERED = re.compile(r"^[ \t]*\d{1,5}(?:[ \t]{2,}|[:|.)][ \t]+|\t)(?=\S)", re.M)
_WORD = re.compile(r"[^\W_]+")


class _Marks(dict):
    """Combining marks and invisible characters to nothing, all others to themselves; each is looked up once."""

    def __missing__(self, code: int) -> int | None:
        ch = chr(code)
        self[code] = None if unicodedata.combining(ch) or unicodedata.category(ch) == "Cf" else code
        return self[code]


_MARKS = _Marks()


def plain(text: str) -> str:
    """``text`` without markup and escapes."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "%" in text and _PERCENT.search(text):
        text = _PERCENT.sub(lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    return text


def unnumbered(text: str) -> str:
    """``plain`` text without line numbers, if it has some."""
    text = plain(text)
    if _NUMBERED.search(text) and len(_NUMBERED.findall(text)) >= 3:
        text = _NUMBERED.sub("", text)
    return text


def packed(text: str) -> bytes:
    """The letters and digits of an ``unnumbered`` text in lower case, as bytes."""
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP)
    return re.sub(r"[\W_]+", "", text.casefold()).encode("utf-8", "replace")


def stream(text: str) -> bytes:
    return packed(unnumbered(text))


def word_ends(text: str) -> list[int]:
    """The ends of the words of an ``unnumbered`` text in its stream."""
    words = _WORD.findall(text.casefold())
    return list(accumulate(map(len, words) if text.isascii() else (len(w.encode("utf-8", "replace")) for w in words)))


def item_stream(question: str | None, answer: str | None) -> tuple[bytes, list[int]]:
    """Stream of an item, and the ends of its words in it."""
    data, ends = b"", []
    for part in (question, answer):
        for w in _WORD.findall(plain(part or "").casefold()):
            data += w.encode("utf-8", "replace")
            ends.append(len(data))
    return data, ends


#: More q-grams than any place can need: of items too short to hold a passage.
NEVER = 1 << 30


def _windows(lengths: np.ndarray, size: int, spared: int) -> np.ndarray:
    """Sums of all runs of ``size`` words without their ``spared`` longest; runs that start late are shorter."""
    padded = np.concatenate((lengths, np.zeros(size - 1, np.int64)))
    runs = np.lib.stride_tricks.sliding_window_view(padded, size)
    return runs.sum(1) - (np.partition(runs, size - spared, 1)[:, size - spared :].sum(1) if 0 < spared < size else runs.sum(1) if spared else 0)


def hidden_words(ends: list[int]) -> np.ndarray:
    """Per word (rows): how many words before it, and from it on, one and two faults can hide from q-grams (columns before1, before2, after1, after2).

    Between faults lie runs too short for a q-gram: with f faults at most f runs of Q - 1 bytes and f words of any length.
    """
    lengths = np.diff(np.array([0, *ends], np.int64))
    n = len(lengths)
    out = np.zeros((n + 1, 4), np.int64)
    for column, (words, edits) in enumerate(((lengths[::-1], 1), (lengths[::-1], 2), (lengths, 1), (lengths, 2))):
        most = np.zeros(n, np.int64)
        for x in range(1, min(REACH, n) + 1):
            fits = _windows(words, x, min(edits, x)) <= edits * (Q - 1)
            fits &= np.arange(n) + x <= n
            if not fits.any():
                break
            most[fits] = x
        out[:n, column] = most
        if column < 2:
            out[:, column] = np.concatenate(([0], most[::-1]))
    return out


def lemma_bounds(ends: list[int], hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte of an item's stream: the least number of different q-grams that a passage keeps whose first shared q-gram starts
    there, the same of any passage that holds the place, and the end of the longest passage from there.

    A passage has ``PASSAGE_WORDS`` words, its edit budget of words that differ and one cut.  Each edited word destroys
    Q - 1 q-grams and as many as it has letters, the cut and the end Q - 1; edits may hide its first words (``hidden``),
    and the first q-gram may start within a word that is edited.
    """
    lengths = np.diff(np.array([0, *ends], np.int64))
    n = len(lengths)
    if n < PASSAGE_WORDS:
        never = np.full(int(lengths.sum()), NEVER, np.int64)
        return never, never, np.zeros_like(never)
    least, at = np.full(n, NEVER, np.int64), np.arange(n)
    # Each further fault needs EDIT_SHARE words; longer passages hold one of these sizes within their budget.
    for size in (PASSAGE_WORDS, *range(PASSAGE_WORDS // EDIT_SHARE * EDIT_SHARE + EDIT_SHARE, LONGEST + 1, EDIT_SHARE)):
        edits = size // EDIT_SHARE
        for start in range(REACH + 1):
            for f in range(min(edits, 2) + 1 if size == PASSAGE_WORDS else 1):
                may = (hidden[:n, f - 1] >= start if f else np.full(n, True)) & (at >= start) & (at + size - start <= n)
                if (f == 0) == (start == 0) and may.any():
                    kept = _windows(lengths, size - start, edits - f) - (Q - 1) * (2 + edits - f)
                    least = np.where(may, np.minimum(least, kept), least)
    least = np.maximum(1, np.minimum(least, np.append(least[1:], NEVER)))
    until = np.array(ends)[np.minimum(at + LONGEST, n - 1)]
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(LONGEST - 1, NEVER, np.int64), least)), LONGEST).min(1)
    return np.repeat(least, lengths), np.repeat(around, lengths), np.repeat(until, lengths)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))


def qgrams(data: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams of a byte array, one per position: lengths are doubled and put together as the binary digits of Q say."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    h, n, out, m = data.astype(np.uint64), 1, None, 0
    while True:
        if Q & n:
            out, m = (h, n) if out is None else (out[: len(data) - m - n + 1] * _power(n) + h[m:], m + n)
        if m == Q:
            return out * np.uint64(0xD6E8FEB86659FD93)
        h, n = h[:-n] * _power(n) + h[n:], 2 * n


class ItemIndex:
    """Q-grams of a block of items: sorted hashes with their (item, position) lists, and a bit table in front."""

    def __init__(self, items: list[tuple[int, str | None, str | None]]):
        self.items, self._halves, self._places = items, None, {}
        self.ids = [i for i, _, _ in items]
        streams = [item_stream(q, a) for _, q, a in items]
        self.bytes, self.ends = [s for s, _ in streams], [e for _, e in streams]
        self.hidden = [hidden_words(e) for e in self.ends]
        places = [lemma_bounds(e, h) for e, h in zip(self.ends, self.hidden)]
        self.offset = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes]))).astype(np.int64)
        self.need, self.around, self.until = (np.concatenate(x).astype(np.int32) for x in zip(*places)) if places else (np.zeros(0, np.int32),) * 3
        self.least = np.array([p[0].min() if len(p[0]) else NEVER for p in places], np.int64)
        grams = [qgrams(np.frombuffer(s, np.uint8)) for s in self.bytes]
        sizes = [len(g) for g in grams]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), sizes)[order]
        self.at = (np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32))[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.key_need = np.minimum.reduceat(self.around[self.offset[self.item] + self.at], self.first) if len(self.keys) else np.zeros(0, np.int64)
        self._tabulate()

    def _tabulate(self) -> None:
        self.shift = np.uint64(64 - 24)
        self.table = np.zeros(1 << 24, np.bool_)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tabulate()

    def places(self, k: int) -> tuple[list[list[int]], list[int]]:
        """Hidden words and needs of an item's places, as lists; those of the items met are kept."""
        if k not in self._places:
            self._places[k] = self.hidden[k].T.tolist(), self.need[self.offset[k] : self.offset[k + 1]].tolist()
        return self._places[k]

    def halves(self) -> list[ItemIndex]:
        if self._halves is None:
            middle = len(self.items) // 2
            self._halves = [ItemIndex(self.items[:middle]), ItemIndex(self.items[middle:])]
        return self._halves

    def shared(self, data: bytes, starts: np.ndarray) -> Iterator[tuple[ItemIndex, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(index, position, document, item, item position) of the shared q-grams of all pairs that may hold a passage; ``starts`` are those of the documents."""
        h = qgrams(np.frombuffer(data, np.uint8))
        if not len(h) or not len(self.keys):
            return
        where = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, h[where]), len(self.keys) - 1)
        good = self.keys[key] == h[where]
        where, key = where[good], key[good]
        # Of what a passage keeps at least half lies together; a q-gram with fewer others around it belongs to none.
        reach = PASSAGE_WORDS * 24 + GAP_BYTES
        crowd = np.searchsorted(where, where + reach) - np.searchsorted(where, where - reach)
        dense = 2 * crowd >= self.key_need[key]
        yield from self._pairs(where[dense], key[dense], h, starts)

    def _pairs(self, where: np.ndarray, key: np.ndarray, h: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        times = self.count[key]
        total = int(times.sum())
        if not total:
            return
        if total > EXPANDED and len(self.items) > 1:
            for half in self.halves():
                if len(half.keys):
                    at = np.minimum(np.searchsorted(half.keys, h[where]), len(half.keys) - 1)
                    good = half.keys[at] == h[where]
                    yield from half._pairs(where[good], at[good], h, starts)
            return
        start = np.repeat(self.first[key] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(total)
        item = self.item[start]
        document = np.repeat(np.searchsorted(starts, where, "right") - 1, times)
        pair = document * len(self.items) + item
        position = np.repeat(where, times)
        if len(starts) * len(self.items) <= COUNTED:
            mine = np.bincount(pair, minlength=len(starts) * len(self.items))[pair] >= self.least[item]
            start, position, item, document, pair = start[mine], position[mine], item[mine], document[mine], pair[mine]
        at = self.at[start].astype(np.int64)
        if not len(at):
            return
        need = self.around[self.offset[item] + at]
        # Overlapping bands: cells of BAND diagonals, each counted with its neighbours.  A passage has at most two pieces, each in one
        # such band (edits within the budget shift it less), so the two fullest bands of a pair must hold what some place needs.
        cell = pair * (1 << 27) + ((position - starts[document] - at) // BAND + (1 << 26))
        order = np.argsort(cell, kind="stable")
        cells, first, n = np.unique(cell[order], return_index=True, return_counts=True)
        least = np.minimum.reduceat(need[order], first)
        pairs, begin, size = np.unique(cells >> 27, return_index=True, return_counts=True)
        near = np.diff(cells) == 1
        full = n + np.concatenate((np.where(near, n[1:], 0), [0])) + np.concatenate(([0], np.where(near, n[:-1], 0)))
        most = np.maximum.reduceat(full, begin)
        fullest = np.maximum.reduceat(np.where(full == np.repeat(most, size), cells, 0), begin)
        second = np.maximum.reduceat(np.where(np.abs(cells - np.repeat(fullest, size)) > 2, full, 0), begin)
        mine = np.isin(pair, pairs[most + second >= np.minimum.reduceat(least, begin)])
        position, document, item, at, pair = position[mine], document[mine], item[mine], at[mine], pair[mine]
        # A passage that starts at a shared q-gram's word holds as many different ones as its place needs.
        spot = pair * (1 << 32) + at
        spots, first = np.unique(spot, return_index=True)
        place = self.offset[item[first]] + at[first]
        enough = np.searchsorted(spots, (spots >> 32 << 32) + self.until[place]) - np.arange(len(spots)) >= self.need[place]
        mine = np.isin(pair, np.unique(spots[enough] >> 32))
        yield self, position[mine], document[mine], item[mine], at[mine]


def exact_runs(position: np.ndarray, document: np.ndarray, item: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(document, item, runs) of every pair: its maximal exact runs as (document start, item start, length), in order of the document."""
    if not len(position):
        return
    diagonal = position - at
    order = np.lexsort((position, diagonal, item, document))
    position, document, item, at, diagonal = position[order], document[order], item[order], at[order], diagonal[order]
    pair = (np.diff(document) != 0) | (np.diff(item) != 0)
    starts = np.flatnonzero(np.concatenate(([True], pair | (np.diff(diagonal) != 0) | (np.diff(position) != 1))))
    lengths = np.diff(np.append(starts, len(position))) + Q - 1
    document, item, position, at = document[starts], item[starts], position[starts], at[starts]
    order = np.lexsort((lengths, at, position, item, document))
    document, item = document[order], item[order]
    rows = list(zip(position[order].tolist(), at[order].tolist(), lengths[order].tolist()))
    cuts = (np.flatnonzero((np.diff(document) != 0) | (np.diff(item) != 0)) + 1).tolist()
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        yield int(document[low]), int(item[low]), rows[low:high]


def differing(a: list[bytes], b: list[bytes]) -> int:
    """Changed, missing and added words between two word lists: edit distance within a band of diagonals."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b or len(a) == len(b) == 1:
        return max(len(a), len(b))
    band, far = BAND + abs(len(a) - len(b)), len(a) + len(b)
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [far] * len(b)
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
        last = row
    return last[-1]


def _touched(ends: list[int], low: int, high: int) -> tuple[int, int]:
    """Words [first, last) with a byte in [low, high), or the one that an empty range cuts."""
    first = bisect_right(ends, low)
    if low == high:
        return first, first + (first < len(ends) and low > 0 and ends[first - 1] != low if first else first < len(ends) and low > 0)
    return first, min(bisect_left(ends, high) + 1, len(ends))


def _words(data: bytes, ends: list[int], first: int, last: int) -> list[bytes]:
    return [data[ends[w - 1] if w else 0 : ends[w]] for w in range(first, last)]


def faults(item: bytes, ends: list[int], document: bytes, document_ends: Callable[[], list[int]], a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Words that differ between two runs.  Where the document's words are torn apart (spaced letters, escapes) its bytes are counted instead, eight to a word."""
    i0, i1, d0, d1 = a[1] + a[2], b[1], a[0] + a[2], b[0]
    mine = _touched(ends, i0, i1)
    by_bytes = max(mine[1] - mine[0], -(-(d1 - d0) // 8))
    if by_bytes < 2:
        return by_bytes
    theirs = document_ends()
    a, b = _words(item, ends, *mine), _words(document, theirs, *_touched(theirs, d0, d1))
    apart = max(len(a), len(b)) - len(set(a) & set(b)) if len(set(a)) == len(a) else 0
    # So many faults in one gap are in no passage: what lies on one side of them would be one.
    return min(by_bytes, apart if apart >= EDIT_SHARE else differing(a, b))


def chains(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Runs in pieces: each goes on where a run of the piece ends, at most ``GAP_BYTES`` on."""
    done, live = [], []
    for d, i, n in runs:
        still = []
        best = None
        for piece in live:
            pd_, pi, pn = piece[-1]
            if d - (pd_ + pn) > GAP_BYTES:
                done.append(piece)
                continue
            still.append(piece)
            if d > pd_ and i > pi and -Q < d - (pd_ + pn) and -Q < i - (pi + pn) <= GAP_BYTES:
                if best is None or abs((d - pd_) - (i - pi)) < abs((d - best[-1][0]) - (i - best[-1][1])):
                    best = piece
        live = still
        if best is None:
            live.append([(d, i, n)])
        else:
            pd_, pi, pn = best[-1]
            cut = max(0, pd_ + pn - d, pi + pn - i)
            if n > cut:
                best.append((d + cut, i + cut, n - cut))
    return done + live


def continued(mine: list[bytes], theirs: list[bytes]) -> list[int]:
    """Least faults with which the first x words of ``mine`` go on in ``theirs``, for x from 0 on."""
    last = list(range(len(theirs) + 1))
    out = [0]
    for i, x in enumerate(mine, 1):
        row = [i]
        for j, y in enumerate(theirs, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        out.append(min(row))
        last = row
    return out


class Passages:
    """The best passage that the exact runs of one document and item make up."""

    def __init__(self, item: bytes, ends: list[int], document: bytes, document_ends: Callable[[], list[int]], hidden: list[list[int]], need: list[int]):
        self.item, self.ends, self.document, self.document_ends = item, ends, document, document_ends
        self.need = need
        self.before1, self.before2, self.after1, self.after2 = hidden
        self.known: dict[tuple[bool, int, int], list[int]] = {}

    def ends_meet(self, first: int, last: int, wrong: int, begin: int, end: int) -> int:
        """Words of a stretch with its best continuations."""
        return self.best(last - first, wrong, self.back(first, begin), self.ahead(last, end)) if self.may_be(first, last, wrong) else 0

    def ahead(self, word: int, position: int) -> list[int]:
        """Faults of going on at item word ``word`` and document byte ``position``."""
        key = (True, word, position)
        if key not in self.known:
            ends = self.document_ends()
            k, n = bisect_right(ends, position), self.after2[word]
            theirs = _words(self.document, ends, k, min(len(ends), k + n + 2))
            if theirs:
                theirs[0] = self.document[position : ends[k]]
            self.known[key] = continued(_words(self.item, self.ends, word, min(len(self.ends), word + n)), theirs)
        return self.known[key]

    def back(self, word: int, position: int) -> list[int]:
        """Faults of going back from item word ``word`` and document byte ``position``, both excluded."""
        key = (False, word, position)
        if key not in self.known:
            ends = self.document_ends()
            k, n = bisect_right(ends, position), self.before2[word]
            theirs = _words(self.document, ends, max(0, k - n - 2), k)
            if position and k < len(ends) and position > (ends[k - 1] if k else 0):
                theirs.append(self.document[ends[k - 1] if k else 0 : position])
            self.known[key] = continued(_words(self.item, self.ends, max(0, word - n), word)[::-1], theirs[::-1])
        return self.known[key]

    def may_be(self, first: int, last: int, wrong: int) -> bool:
        """Whether words [first, last) with so many faults can be a passage together with what q-grams do not show at their ends."""
        hidden = max(self.before2[first], self.after2[last], self.before1[first] + self.after1[last])
        left = (last - first + hidden) // EDIT_SHARE - wrong  # faults that the budget leaves for the ends; none hides nothing
        if left < 2:
            hidden = max(self.before1[first], self.after1[last]) if left == 1 else 0
        return left >= 0 and last - first + hidden >= PASSAGE_WORDS


    def anchors(self, first: int, last: int) -> list[tuple[int, int, int]]:
        """Exact places in the document of three words in a row that follow or precede words [first, last): runs too short for a q-gram."""
        out = []
        for w in [*range(max(0, first - REACH), max(0, first - 2)), *range(last, min(len(self.ends), last + REACH) - 2)]:
            begin = self.ends[w - 1] if w else 0
            wanted = self.item[begin : self.ends[w + 2]]
            if len(wanted) < Q:  # longer ones have q-grams
                at = self.document.find(wanted)
                while at >= 0:
                    out.append((at, begin, len(wanted)))
                    at = self.document.find(wanted, at + 1)
        return out

    @staticmethod
    def best(words: int, wrong: int, back: list[int], ahead: list[int]) -> int:
        """Most words of a stretch with its continuations at both ends, within the budget; 0 if beyond it."""
        top = 0
        for x, f in enumerate(back):
            room = (words + x + len(ahead) - 1) // EDIT_SHARE - wrong - f
            if room < 0:
                continue
            y = bisect_right(ahead, room) - 1
            while y >= 0 and (wrong + f + ahead[y]) * EDIT_SHARE > words + x + y:
                y -= 1
            if y >= 0:
                top = max(top, words + x + y)
        return top

    def longest(self, runs: list[tuple[int, int, int]]) -> int:
        """Words of the item in the best passage of one or two pieces; 0 or fewer than ``PASSAGE_WORDS`` if there is none."""
        top, half = self.searched(runs)
        if half and top < PASSAGE_WORDS:
            # Half a passage is there: its other piece may be of words so short that no q-gram shows it.
            more = self.anchors(*half)
            if more:
                top = max(top, self.searched(_merged([*runs, *more]))[0])
        return top

    def enough(self, pieces: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """The pieces that hold the q-grams a passage needs at their place, alone or with one next to them in the item, or half of its words."""
        held: dict[tuple[int, int], int] = {}
        need: dict[tuple[int, int], int] = {}
        for piece in pieces:
            where = piece[0][1], piece[-1][1] + piece[-1][2]
            need[where] = min(need.get(where, NEVER), *(self.need[i] for _, i, _ in piece))
            held[where] = max(held.get(where, 0), sum(max(1, n - Q + 1) for _, _, n in piece))
        good = {where for where, grams in held.items() if grams >= need[where] or bisect_right(self.ends, where[1]) - bisect_left(self.ends, where[0]) >= PASSAGE_WORDS // 2}
        places = sorted(held)
        starts = [a for a, _ in places]
        for a in places:
            for b in places[bisect_left(starts, a[1] - 2 * GAP_BYTES) : bisect_right(starts, a[1] + 2 * GAP_BYTES)]:
                if a is not b and held[a] + held[b] >= min(need[a], need[b]):
                    good |= {a, b}
        return [piece for piece in pieces if (piece[0][1], piece[-1][1] + piece[-1][2]) in good]

    def searched(self, runs: list[tuple[int, int, int]]) -> tuple[int, tuple[int, int] | None]:
        """The best passage over ``runs``, and the longest stretch that may be a half of one."""
        ends = self.ends
        together = self.enough(chains(runs))
        top, half = 0, (0, 0)
        pieces: list[list[tuple[int, int, int, int, int]]] = []  # (first word, last word, begin and end in the document, faults)
        for piece in together:
            between = [faults(self.item, ends, self.document, self.document_ends, a, b) for a, b in zip(piece, piece[1:])]
            spans = []
            for x, (d, i, _) in enumerate(piece):
                first = bisect_left(ends, i) + 1 if i else 0
                begin = d + (ends[first - 1] if first else 0) - i
                wrong = 0
                for y in range(x, len(piece)):
                    wrong += between[y - 1] if y > x else 0
                    last = bisect_right(ends, piece[y][1] + piece[y][2])
                    # no other piece has more than a passage's words, or it would be one by itself
                    if wrong * EDIT_SHARE > last - first + 2 * PASSAGE_WORDS:
                        continue
                    if last - first >= PIECE_WORDS:
                        end = piece[y][0] + ends[last - 1] - piece[y][1]
                        spans.append((first, last, begin, end, wrong))
                        if wrong * EDIT_SHARE <= last - first:
                            top = max(top, last - first)
                        if wrong <= PASSAGE_WORDS // EDIT_SHARE and last - first > half[1] - half[0]:
                            half = first, last
            if spans:
                pieces.append(spans)
        half = half if half[1] - half[0] >= PASSAGE_WORDS // 2 else None
        if top >= PASSAGE_WORDS:
            return top, half
        for spans in pieces:
            for first, last, begin, end, wrong in spans:
                top = max(top, self.ends_meet(first, last, wrong, begin, end))
        if top >= PASSAGE_WORDS or len(pieces) < 2:
            return top, half
        # Two pieces: one goes on, a few words on or over, where the other ends; the budget holds for both together.
        # A phrase that the document repeats gives many spans of the same words: they are taken by how they can be continued.
        places: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for spans in pieces:
            for first, last, begin, end, wrong in spans:
                places.setdefault((first, last, wrong), []).append((begin, end))
        starting: dict[int, list[tuple[int, int, int]]] = {}
        for span in places:
            starting.setdefault(span[0], []).append(span)
        profiles: dict[tuple[int, int, int], set] = {}

        def ways(span: tuple[int, int, int]) -> set:
            if span not in profiles:
                profiles[span] = {(tuple(self.back(span[0], begin)), tuple(self.ahead(span[1], end))) for begin, end in places[span]}
            return profiles[span]

        for a in places:
            first, last, wrong = a
            for middle in range(last - REACH, last + REACH + 1):
                for b in starting.get(middle, ()):
                    _, last2, wrong2 = b
                    gap = max(0, middle - last)
                    if last2 <= last or middle <= first or gap and gap > max(self.after2[last], self.before2[middle], self.after1[last] + self.before1[middle]) or not self.may_be(first, last2, wrong + wrong2 + (gap > 0)):
                        continue
                    for back, on in ways(a):
                        for before, ahead in ways(b):
                            lost = min((on[x] + before[gap - x] for x in range(gap + 1) if x < len(on) and gap - x < len(before)), default=gap) if gap else 0
                            top = max(top, self.best(last2 - first, wrong + wrong2 + lost, back, ahead))
        return top, half


def _merged(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of which those that overlap on a diagonal are one."""
    out: list[tuple[int, int, int]] = []
    for d, i, n in sorted(runs, key=lambda r: (r[0] - r[1], r[0])):
        if out and out[-1][0] - out[-1][1] == d - i and d <= out[-1][0] + out[-1][2]:
            last = out[-1]
            out[-1] = (last[0], last[1], max(last[2], d + n - last[0]))
        else:
            out.append((d, i, n))
    return sorted(out)


def found_in(index: ItemIndex, ids: list[int], texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
    """(document id, item id, words) of the passages in a batch of documents."""
    begin = 0
    while begin < len(texts):
        cleaned, streams, size = [], [], 0
        while begin + len(streams) < len(texts) and (not streams or size <= CHUNK):
            text = texts[begin + len(streams)]
            cleaned.append(unnumbered(text) if text else "")
            streams.append(packed(cleaned[-1]))
            size += len(streams[-1]) + 1
        starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])[:-1])).astype(np.int64)
        known: dict[int, list[int]] = {}

        def ends_of(d: int) -> list[int]:
            if d not in known:
                known[d] = word_ends(cleaned[d])
            return known[d]

        for part, position, document, item, at in index.shared(b"\0".join(streams), starts):
            for d, k, runs in exact_runs(position - starts[document], document, item, at):
                words = Passages(part.bytes[k], part.ends[k], streams[d], partial(ends_of, d), *part.places(k)).longest(runs)
                if words >= PASSAGE_WORDS:
                    yield ids[begin + d], part.ids[k], words
        begin += len(streams)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None, str | None]]]:
    """The items, read one partition at a time, in blocks of at most BLOCK_CHARS characters, of which one is held."""
    block, size = [], 0
    for row in items.select("item_id", "question", "answer").filter("item_id is not null").distinct().orderBy("item_id", "question", "answer").toLocalIterator():
        length = len(row[1] or "") + len(row[2] or "")
        if block and size + length > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += length
    if block:
        yield block


FOUND = "doc_id bigint, item_id bigint, n_words int"


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words): documents with a passage of an item, with the words of the longest."""
    spark = documents.sparkSession
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    blocks = item_blocks(items)
    block = next(blocks, None)
    space, n, out = None, 0, None
    while block is not None:
        sent = spark.sparkContext.broadcast(ItemIndex(block))  # about 30 bytes for each of at most BLOCK_CHARS characters
        following = next(blocks, None)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(found_in(sent.value, batch["doc_id"].tolist(), batch["text"].tolist()), columns=["doc_id", "item_id", "n_words"])

        out = texts.mapInPandas(search, FOUND)
        if following is not None or n:
            space = space or Workspace(spark, "leakage")
            part, _ = space.append(out, "found", "block", n)
            out = space.whole("found", part, "block")
            sent.destroy()
        block, n = following, n + 1
    if out is None:
        return spark.createDataFrame([], FOUND)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
