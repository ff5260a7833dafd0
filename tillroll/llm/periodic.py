"""Stretches of words that repeat with a period, caught while words are appended.

``Catchers`` takes words as they come. For every power of two there are the blocks completed so
far; each block catches with the words that follow it: a copy of it between two and four block
lengths on (for single words, from one on) shows a period, and every appended word is
compared, as the end of a suffix of block length, with the two blocks whose turn it
is. A period of p words has a block of more than p / 4 words within every p words, so a
square of that period is always caught. Suffixes are compared by differences of one running
sum; a caught copy is compared word by word and followed to both sides. When words enough
agree, the squares merge into a run, which goes on growing with later words. Copies inside a
known run whose period divides theirs say nothing new and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import mix, pieces

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
CHUNK = 1 << 18  # words appended at a time

_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


class Catchers:
    """Runs of the words appended so far: ``least`` words or more, ``times`` periods or more.

    ``longest`` bounds the periods looked for.
    """

    def __init__(self, longest: int, least: int = LEAST, times: int = TIMES):
        self.longest, self.least, self.times = longest, least, times
        self.n = 0
        self.words = np.zeros(1024, dtype=np.int64)
        self.sums = np.zeros(1025, dtype=np.uint64)  # of the words before, each times its power
        self.powers = _powers(1024)
        self.runs: dict[tuple[int, int], int] = {}  # start and period: end
        self.open: list[tuple[int, int]] = []  # period and start of stretches that reach the last word

    def append(self, new: np.ndarray) -> list[tuple[int, int, int]]:
        """The runs these words begin or continue, as start, length and period."""
        before, self.n = self.n, self.n + len(new)
        while self.n > len(self.words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.sums = np.concatenate([self.sums, np.zeros(len(self.words) // 2, np.uint64)])
        self.words[before : self.n] = new
        if len(new) > len(self.powers):
            self.powers = _powers(1 << (len(new) - 1).bit_length())
        terms = mix(new.astype(np.uint64)) * self.powers[: len(new)] * _power(before)
        self.sums[before + 1 : self.n + 1] = self.sums[before] + np.cumsum(terms, dtype=np.uint64)
        self.told: dict[tuple[int, int], None] = {}
        waiting, self.open = sorted(self.open), []
        for period, start in waiting:
            self._settle(start, self._right(before, period), period)
        level = 0
        while (2 << level if level else 1) <= self.longest:
            for step in (2, 3) if level else (1, 2, 3):
                self._catch(level, step, before)
            level += 1
        return [(start, self.runs[start, period] - start, period) for start, period in self.told]

    def _catch(self, level: int, step: int, before: int) -> None:
        """Compare the new suffixes of 2^level words with the blocks that began ``step`` blocks before theirs."""
        size = 1 << level
        first = max(0, before - size + 1, step << level)  # suffixes by their first words
        upto = self.n - size + 1
        if first >= upto:
            return
        if size > len(self.powers):
            self.powers = _powers(size)
        at = np.arange(first, upto)
        suffixes = self.sums[first + size : upto + size] - self.sums[first:upto]
        low = (first >> level) - step
        blocks = np.diff(self.sums[low << level : (((upto - 1 >> level) - step + 1) << level) + 1 : size])
        factors = self.powers[at & (size - 1)] * _power(step << level)
        hits = np.flatnonzero(blocks[(at >> level) - step - low] * factors == suffixes)
        if not len(hits):
            return
        at = at[hits]
        begin = (at >> level) - step << level
        period = at - begin
        new = period <= self.longest
        for (start, known), end in self.runs.items():
            if end - start >= 3 * size:
                lo, hi = np.searchsorted(at, (start, end - size + 1))
                if lo < hi:
                    new[lo:hi] &= (begin[lo:hi] < start) | (period[lo:hi] % known != 0)
        at, period = at[new], period[new]
        if not len(at):
            return
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        heads = np.flatnonzero((np.diff(period, prepend=-1) != 0) | (np.diff(at, prepend=-1) != size))
        tails = np.append(heads[1:], len(at)) - 1
        heads, tails, period = at[heads], at[tails], period[heads]
        # A stretch goes less than a block beyond its blocks, unless it goes on in earlier or later words.
        most = tails - heads + size + 2 * (size - 1)
        wanted = np.maximum(self.least, self.times * period) - period
        maybe = (most >= wanted) | (tails + 2 * size > self.n) | (heads - size < before)
        for head, tail, p in zip(heads[maybe].tolist(), tails[maybe].tolist(), period[maybe].tolist()):
            if (self.words[head : tail + size] == self.words[head - p : tail + size - p]).all():
                self._settle(self._left(head, p), self._right(tail + size, p), p)

    def _right(self, at: int, period: int) -> int:
        """The first place from ``at`` on whose word differs from the one a period before."""
        step = 16
        while at < self.n:
            end = min(self.n, at + step)
            same = self.words[at:end] == self.words[at - period : end - period]
            if not same.all():
                return at + int(same.argmin())
            at, step = end, 2 * step
        return at

    def _left(self, at: int, period: int) -> int:
        """The first place up to ``at`` from which all words equal the ones a period before."""
        step = 16
        while at > period:
            begin = max(period, at - step)
            same = self.words[begin:at] == self.words[begin - period : at - period]
            if not same.all():
                return at - int(same[::-1].argmin())
            at, step = begin, 2 * step
        return at

    def _settle(self, start: int, end: int, period: int) -> None:
        """Words from ``start`` to ``end`` equal the ones a period before."""
        if end == self.n:
            self.open.append((period, start))
        first = start - period
        if end - first < max(self.least, self.times * period) or self.runs.get((first, period)) == end:
            return
        if (first, period) not in self.runs:
            for prime in _primes(period):
                part = period // prime  # then words of a shorter period
                if (self.words[first : first + period] == self.words[first + part : first + part + period]).all():
                    return
        self.runs[first, period] = end
        self.told[first, period] = None


def _primes(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def find_runs(texts: list[np.ndarray], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of each list of word numbers, in order of start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lots: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        if len(words) >= max(least, times):
            lots.setdefault(len(words).bit_length(), []).append(i)
    for lot in lots.values():
        # Texts of like length one after the other; words of their own in between match nothing.
        longest = max(len(texts[i]) for i in lot)
        stream = np.concatenate([x for n, i in enumerate(lot, 1) for x in (texts[i], np.array([-n]))])
        first = np.cumsum([0] + [len(texts[i]) + 1 for i in lot])
        catchers = Catchers(longest // times, least, times)
        for begin in range(0, len(stream), CHUNK):
            catchers.append(stream[begin : begin + CHUNK])
        for (start, period), end in sorted(catchers.runs.items()):
            text = int(np.searchsorted(first, start, side="right")) - 1
            out[lot[text]].append((start - int(first[text]), end - start, period))
    return out


_RESULT = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _collapse(least: int, times: int):
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            numbers = _Numbers()
            texts = [(text or b"").split() for text in piece.column("text").to_pylist()]
            coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]
            found = find_runs(coded, least, times)
            kept = []
            for words, runs in zip(texts, found, strict=True):
                if runs:
                    keep = np.ones(len(words), dtype=bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                kept.append(b" ".join(words))
            columns = [
                piece.column("id"),
                pa.array([len(words) for words in texts], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], kind),
                pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    return scan


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` and ``collapsed``.

    Words are what stands between the bytes 0x20 and 0x09-0x0D, compared byte by byte. ``runs``
    are the stretches of ``least`` or more words that repeat with a smallest period they hold ``times``
    or more times, as long as they go, in order of start and period (words are counted from
    zero). ``collapsed`` is the text without what any run holds after its first period, its
    words joined by one space. Null and empty texts have no words, no runs and an empty
    collapsed text. Repeated rows and null ids are rows like others; no documents give no rows. Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    found = texts.mapInArrow(_collapse(least, times), _RESULT)
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
