"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment.

Texts are lower-cased; every run of other bytes than letters and digits is one space.
Benchmark items are cut into windows of ``WINDOW`` bytes, ``APART`` bytes apart, so any
``WINDOW + APART - 1`` bytes of an item hold one; a shorter item is one window, and one under
``LEAST`` bytes is only found as it is, between spaces. A document holds a window if part of it is at most ``EDITS`` of the window's
length edits away. By the q-gram lemma such a part shares at least
``n - q + 1 - q * edits`` q-grams with the window, and they lie on ``edits + 1`` neighbouring
diagonals, so in one of the overlapping bands of twice that width. Bands that reach the count
are verified by alignment inside the band.

A q-gram is eight bytes, one 64-bit number, so equal numbers are equal q-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import pieces, text_bytes

Q = 8
WINDOW = 96
APART = 12
EDITS = 0.1
LEAST = 32  # shorter items are looked up as whole strings, without edits
BLOCK = 1 << 18  # bytes of benchmark text looked up in one pass over the documents
HITS = 2 << 20  # q-gram hits looked at together

_STEP = int(WINDOW * EDITS) + 1  # diagonals between the starts of bands
_WIDTH = 2 * _STEP
_SPAN = WINDOW + _WIDTH  # bytes of a text that hold all hits of a band
_ORIGIN = WINDOW + _STEP  # diagonals are counted from one strip before the first possible one
_FILTER = 22  # bits of the table that rules out most q-grams
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_PLAIN = np.full(256, 0x20, dtype=np.uint8)
for _run in (range(48, 58), range(97, 123), range(128, 256)):
    _PLAIN[list(_run)] = list(_run)
_PLAIN[65:91] = np.arange(97, 123)


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes end to end, each text followed by a space, and where each text begins."""
    raw, bounds = text_bytes(column)
    ends = np.zeros(len(raw) + len(bounds) - 1, dtype=np.uint8)
    n = len(bounds) - 1
    closing = bounds[1:] + np.arange(n)
    keep = np.ones(len(ends), dtype=bool)
    keep[closing] = False
    ends[keep] = _PLAIN[raw]
    ends[closing] = 0x20
    gap = ends == 0x20
    drop = np.zeros(len(ends), dtype=bool)
    drop[1:] = gap[1:] & gap[:-1]
    drop[closing] = False  # the space that ends a text stays
    starts = np.concatenate([[0], np.cumsum(~drop)])
    return ends[~drop], starts[np.append(bounds[:-1] + np.arange(n), len(ends))]


def _grams(text: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(text) - Q + 1), dtype=np.uint64)
    for k in range(Q):
        out |= text[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


class BenchmarkIndex:
    """The windows of a block of benchmark items, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[int] = []
        self.tiny: dict[bytes, set[int]] = {}  # items without a q-gram
        windows = []
        for item, text in items:
            plain = _plain(pa.array([text.lower()]))[0].tobytes().strip()
            n = len(plain)
            if n < Q:
                if n:
                    self.tiny.setdefault(plain, set()).add(item)
                continue
            starts = [*range(0, max(1, n - WINDOW), APART), n - WINDOW] if n > WINDOW else [0]
            for start in sorted(set(starts)):
                windows.append(np.frombuffer(plain[start : start + WINDOW], dtype=np.uint8))
                self.items.append(item)
        self.sizes = np.array([len(w) for w in windows], dtype=np.int64)
        self.edits = np.where(self.sizes < LEAST, 0, self.sizes * EDITS).astype(np.int64)
        self.needed = self.sizes - Q + 1 - Q * self.edits
        self.texts = np.zeros((len(windows), WINDOW), dtype=np.uint8)
        for row, window in zip(self.texts, windows, strict=True):
            row[: len(window)] = window
        grams = [_grams(w) for w in windows]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        window = np.repeat(np.arange(len(windows)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.window, self.place = window[order].astype(np.int32), place[order].astype(np.int16)
        self.likely = np.zeros(1 << _FILTER, dtype=bool)
        self.likely[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * _SPREAD) >> np.uint64(64 - _FILTER)).astype(np.int64)

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the text whose q-gram the windows hold too, and its row in the index."""
        at = np.flatnonzero(self.likely[self._slot(grams)])
        row = np.searchsorted(self.grams, grams[at])
        row[row == len(self.grams)] = 0
        same = self.grams[row] == grams[at]
        return at[same], row[same]

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text number, window and band of every band with enough q-grams.

        Positions are worked off in runs of some ``HITS`` hits. The hits of a band stand within
        ``_SPAN`` bytes, and every run looks that far beyond its end, so the run in which a band
        begins sees all of it.
        """
        at, row = self.shared(_grams(text))
        upto = np.cumsum(self.first[row + 1] - self.first[row])
        runs = [np.zeros((0, 3), dtype=np.int64)]
        begin = 0
        while begin < len(at):
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + HITS, side="right")))
            beyond = int(np.searchsorted(at, at[end - 1] + _SPAN, side="right"))
            runs.append(self._full_bands(at[begin:beyond], row[begin:beyond], starts))
            begin = end if beyond < len(at) else len(at)
        found = np.concatenate(runs)
        if len(runs) > 2:
            found = np.unique(found, axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def _full_bands(self, at: np.ndarray, row: np.ndarray, starts: np.ndarray) -> np.ndarray:
        counts = self.first[row + 1] - self.first[row]
        begin = np.cumsum(counts) - counts
        entry = np.arange(counts.sum()) - np.repeat(begin - self.first[row], counts)
        at = np.repeat(at, counts)
        doc = np.searchsorted(starts, at, side="right") - 1
        window = self.window[entry]
        diagonal = at - starts[doc] - self.place[entry] + _ORIGIN
        band = diagonal // _STEP
        bands = int(band.max()) + 2 if len(band) else 1
        key = (doc * len(self.sizes) + window) * bands + band
        # The hits of a band are those of two neighbouring strips.
        slots = (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - _FILTER)).astype(np.int64)
        other = ((key - 1).astype(np.uint64) * _SPREAD >> np.uint64(64 - _FILTER)).astype(np.int64)
        counts = np.bincount(slots, minlength=1 << _FILTER)
        counts += np.bincount(other, minlength=1 << _FILTER)
        some = np.maximum(counts[slots], counts[other]) >= self.needed[window]
        strips, n = np.unique(key[some], return_counts=True)
        low = np.unique(np.concatenate([strips, strips - 1]))
        upto = np.concatenate([[0], np.cumsum(n)])
        total = upto[np.searchsorted(strips, low + 1, side="right")] - upto[np.searchsorted(strips, low)]
        pair = low // bands
        window = pair % len(self.sizes)
        enough = total >= self.needed[window]
        return np.stack([pair // len(self.sizes), window, low % bands], axis=1)[enough]

    def distances(self, text, starts, doc, window, band) -> np.ndarray:
        """Least edits between each window and a part of the text, inside its band."""
        out = np.full(len(doc), WINDOW, dtype=np.int64)
        for begin in range(0, len(doc), 2048):
            part = slice(begin, begin + 2048)
            d, w = doc[part], window[part]
            diagonal = band[part] * _STEP - _ORIGIN
            low, high = starts[d], starts[d + 1]
            cost = np.zeros((len(d), _WIDTH), dtype=np.int16)
            slope = np.arange(_WIDTH, dtype=np.int16)
            end = np.full(len(d), WINDOW, dtype=np.int64)
            sizes = self.sizes[w]
            for j in range(int(sizes.max(initial=0))):
                # Before row j is added, column k stands for text position diagonal + k + j.
                at = (low + diagonal + j)[:, None] + slope
                inside = (at >= low[:, None]) & (at < high[:, None])
                differs = text[np.clip(at, 0, len(text) - 1)] != self.texts[w, j][:, None]
                step = cost + (differs | ~inside)
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(step - slope, axis=1) + slope
                done = sizes == j + 1
                end[done] = cost[done].min(axis=1)
            out[part] = end
        return out

    def leaks(self, column: pa.Array) -> list[dict[int, int]]:
        """For each text the items found in it, with the least edits of one of their windows."""
        text, starts = _plain(column)
        out: list[dict[int, int]] = [{} for _ in range(len(column))]
        if self.tiny:
            raw = b" " + text.tobytes()
            for plain, items in self.tiny.items():
                word, at = b" " + plain + b" ", -1
                while (at := raw.find(word, at + 1)) >= 0:
                    d = int(np.searchsorted(starts, at, side="right")) - 1
                    if at + len(plain) < starts[d + 1]:  # not across two texts
                        out[d] |= dict.fromkeys(items, 0)
                        at = int(starts[d + 1]) - 2  # on with the next text
        if not self.items or len(text) < Q:
            return out
        doc, window, band = self.candidates(text, starts)
        edits = self.distances(text, starts, doc, window, band)
        for d, w, e in zip(doc.tolist(), window.tolist(), edits.tolist(), strict=True):
            if e <= self.edits[w]:
                item, size = self.items[w], int(self.sizes[w])
                if size < LEAST:
                    own = b" " + text[starts[d] : starts[d + 1]].tobytes()
                    if b" " + self.texts[w, :size].tobytes() + b" " not in own:
                        continue
                out[d][item] = min(e, out[d].get(item, e))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Indexes over blocks of bounded size; the items come to the driver one block at a time."""
    items, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(
        F.col(item_col).isNotNull() & F.col(text_col).isNotNull()
    )
    for item, text in rows.distinct().orderBy(item_col, text_col).toLocalIterator():
        items.append((item, text))
        size += len(text.encode())
        if size >= BLOCK:
            yield BenchmarkIndex(items)
            items, size = [], 0
    if items:
        yield BenchmarkIndex(items)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, ``contaminated``, ``items`` and ``edits``.

    ``items`` are the benchmark items found, by number, ``edits`` the least edits of each. Null
    and empty texts hold nothing; null items and those without a letter or digit are
    left out; items that share a number count as one. Null ids and repeated rows are
    kept as they are; no other column is read. The benchmark is looked up in blocks of
    bounded size, each in one pass over the documents; rows go from one pass to the next.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.lower(F.col(text_col).cast("string")).alias("text"),
        F.expr("cast(array() as array<struct<item: long, edits: int>>)").alias("leaks"),
    )
    kind = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())]))
    for index in _blocks(benchmark, item_col, item_text_col):

        def scan(batches, index=index):
            for part in pieces(batches):
                new = index.leaks(part.column("text"))
                old = part.column("leaks").to_pylist()
                leaks = [
                    o + [{"item": i, "edits": e} for i, e in sorted(n.items())] for o, n in zip(old, new, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text"), pa.array(leaks, kind)], names=["id", "text", "leaks"]
                )

        found = found.mapInArrow(scan, found.schema)
    # Items that share a number may stand in two blocks.
    items = F.array_sort(F.array_distinct(F.col("leaks.item")))
    edits = F.transform(
        items, lambda i: F.array_min(F.transform(F.filter("leaks", lambda x: x["item"] == i), lambda x: x["edits"]))
    )
    return found.select(
        F.col("id").alias(id_col),
        (F.size("leaks") > 0).alias("contaminated"),
        items.alias("items"),
        edits.alias("edits"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    lower = F.lower(F.col(columns[docs.columns.index(text_col)]).cast("string"))
    for index in _blocks(benchmark, item_col, item_text_col):

        def scan(batches, index=index):
            for part in pieces(batches, "lowered"):
                clean = [not leaks for leaks in index.leaks(part.column("lowered"))]
                yield part.filter(pa.array(clean, pa.bool_())).select(columns)

        plain = plain.withColumn("lowered", lower).mapInArrow(scan, plain.schema)
    return plain.toDF(*docs.columns)
