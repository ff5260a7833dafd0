"""Words of whole Arrow text columns at once, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z is lower-cased.
Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a finaliser with shifts and odd factors)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}  # filled within tasks


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables[name] = _powers(_BASE if name == "up" else pow(_BASE, -1, 1 << 64))
    return _tables[name]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batches, column: str = "text", most: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``most`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes.astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    starts: np.ndarray  # byte positions within all texts end to end
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry than texts
    raw: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit id for each lower-cased word, the same in every task."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        begin = 0
        while begin < len(out):
            at = int(self.starts[begin])
            end = int(np.searchsorted(self.ends, at + _BLOCK, side="right"))
            if end <= begin:  # one word longer than a block
                out[begin] = _long_word(self.raw[at : self.ends[begin]])
                begin += 1
                continue
            codes = _BYTES[LOWER[self.raw[at : self.ends[end - 1]]]]
            codes *= _table("up")[: len(codes)]
            upto = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(codes, out=upto[1:])
            s, e = self.starts[begin:end] - at, self.ends[begin:end] - at
            out[begin:end] = (upto[e] - upto[s]) * _table("down")[s]
            begin = end
        out += (self.ends - self.starts).astype(np.uint64) * np.uint64(_BASE)
        return mix(out)


def _long_word(raw: np.ndarray) -> np.uint64:
    total = 0
    step = pow(_BASE, _BLOCK, 1 << 64)
    for n, begin in enumerate(range(0, len(raw), _BLOCK)):
        codes = _BYTES[LOWER[raw[begin : begin + _BLOCK]]]
        part = int((codes * _table("up")[: len(codes)]).sum(dtype=np.uint64))
        total = (total + part * pow(step, n, 1 << 64)) % (1 << 64)
    return np.uint64(total)


def words(column: pa.Array | pa.ChunkedArray) -> Words:
    raw, bounds = text_bytes(column)
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = ~inside
    starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds), raw)


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``, zero for empty runs."""
    upto = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[first[1:]] - upto[first[:-1]]
