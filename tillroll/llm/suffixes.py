"""Byte strings of ``LENGTH`` that already stand in a document with a smaller id, by suffix arrays.

1. Tiles: every string of LENGTH bytes belongs to the place of its least k-gram by hash (the
   leftmost one), which depends on the string alone; neighbouring strings with the same place are
   a tile. Equal strings lie in tiles with equal k-grams, so a tile whose k-gram no other document
   has is done, and so is one whose k-gram comes with one and the same tile everywhere.
2. Documents are held in shards of some megabytes. A shard names each k-gram once, with the
   hash of its tile and the least id, so a hot k-gram is a row per shard; ranges of k-grams
   are merged and answer each shard. Ranges get wider with the table, as shards times ranges are rows.
3. The tiles that are left are dealt out by their k-grams, a row for each shard and range. Within a range
   they go lot by lot, and each lot gets a suffix array of its different tiles by Larsson and Sadakane's refinement (only groups not yet told apart are sorted again, by the
   ranks twice as far on) and common prefixes by Kasai's rule; suffixes that have LENGTH
   bytes in common are one string, and the least id that has it decides.
4. A lot too large for one task (many different tiles around one k-gram) is split. Each part
   lists its strings in the order of its suffix array; parts are merged by binary search
   of each list in the list of those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.katz import pack, pack_keys, unpack, unpack_keys
from tillroll.llm.words import mix, pieces
from tillroll.staging import stage

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM + 1  # k-grams of a string
SHARD = 4 << 20  # bytes of text
RANGE = 500_000  # k-grams named by all shards, for each range
RANGES = 256  # ranges get wider if there are more
WIDEST = 4 * RANGE  # k-grams of a range at most
LOT = 1 << 19  # bytes of tiles in a lot
SEGMENT = 1 << 15  # bytes looked at a time
FREE, EARLIER, CONTESTED = 0, 1, 2
WHOLE = -1  # all lots of a range that are not split

_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}  # filled within tasks


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        out = np.full(SEGMENT + 4 * LENGTH, base, dtype=np.uint64)
        out[0] = 1
        _tables[name] = np.cumprod(out, dtype=np.uint64)
    return _tables[name]


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _segment(raw: np.ndarray, begin: int, upto: int) -> tuple[np.ndarray, ...]:
    """For the strings that begin from ``begin`` to ``upto``: place of the least k-gram; sums and hashes to go on with."""
    part = raw[begin : upto + LENGTH - 1].astype(np.uint64)
    eight = part
    for n in (1, 2, 4):
        eight = eight[: len(eight) - n] | eight[n:] << np.uint64(8 * n)
    n = len(part) - GRAM + 1
    grams = mix(eight[:n] * np.uint64(_BASE) + mix(eight[8 : 8 + n]) + eight[GRAM - 8 : GRAM - 8 + n] * np.uint64(0xA0761D6478BD642F))
    # Forty bits of hash, then the place: the least is the leftmost of the least.
    least = grams >> np.uint64(24) << np.uint64(24) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(mix(part + np.uint64(1)) * _table("up")[: len(part)], out=sums[1:])
    return place, grams, sums


class Tiles:
    """The tiles of a shard: first string, number of strings, k-gram, hash of the bytes, document."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, known: np.ndarray):
        """``bounds``: where texts begin, and the end; ``known``: documents to look at."""
        self.raw = raw
        held = np.maximum(0, np.diff(bounds) - LENGTH + 1) * known
        lists = [np.zeros((5, 0), dtype=np.int64)]
        whole = np.zeros(len(raw), dtype=bool)  # places where a string of a document begins
        for begin, n in zip(bounds.tolist(), held.tolist()):
            whole[begin : begin + n] = True
        for begin in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
            upto = min(begin + SEGMENT, len(raw) - LENGTH + 1)
            starts = np.flatnonzero(whole[begin:upto])
            if not len(starts):
                continue
            place, grams, sums = _segment(raw, begin, upto)
            place = place[starts]
            heads = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
            first, count, place = starts[heads], np.diff(heads, append=len(starts)), place[heads]
            ends = first + count + LENGTH - 1
            hashes = mix((sums[ends] - sums[first]) * _table("down")[first] + mix(((place - first) * 64 + count).astype(np.uint64)))
            gram = mix(grams[place] ^ np.uint64(_BASE)) >> np.uint64(16)  # least hashes are small; these are even
            doc = np.searchsorted(bounds, first + begin, side="right") - 1
            lists.append(np.stack([first + begin, count, gram.astype(np.int64), hashes.view(np.int64), doc]))
        self.first, self.count, self.gram, self.hash, self.doc = np.concatenate(lists, axis=1)

    def sort(self, ids: np.ndarray) -> None:
        """Put tiles in order of k-gram, hash and document id; mark where k-grams and tiles change."""
        order = np.argsort(self.gram)
        again = np.diff(self.gram[order], prepend=-1) == 0
        again = np.flatnonzero(again | np.append(again[1:], False))  # k-grams that come more than once
        some = order[again]
        order[again] = some[np.lexsort((ids[self.doc[some]], self.hash[some], self.gram[some]))]
        for name in ("first", "count", "gram", "hash", "doc"):
            setattr(self, name, getattr(self, name)[order])
        self.id = ids[self.doc]
        new_gram = np.diff(self.gram, prepend=-1) != 0
        new_tile = new_gram.copy()
        new_tile[1:] |= self.hash[1:] != self.hash[:-1]
        self.of_gram, self.of_tile = np.cumsum(new_gram) - 1, np.cumsum(new_tile) - 1
        self.grams, self.tiles = np.flatnonzero(new_gram), np.flatnonzero(new_tile)


def _shards(batches) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    for piece in pieces(batches, most=SHARD):
        text = pc.fill_null(piece.column("text"), b"")
        sizes = pc.binary_length(text).to_numpy().astype(np.uint64)
        raw = b"".join(text.to_pylist())
        columns = [
            pa.array([number], pa.int64()),
            pa.array([piece.column("id").to_pylist()], pa.list_(pa.int64())),
            pa.array([pack(sizes)], pa.binary()),
            pa.array([len(raw)], pa.int64()),
            pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "sizes", "bytes", "text"])
        number += 1


def _load(row) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, Tiles]:
    """Ids of a shard (None: null), ids as numbers, its bytes, where texts begin, and its tiles in order."""
    ids = [None if i is None or i != i else int(i) for i in row["ids"]]
    bounds = np.append(0, np.cumsum(unpack(row["sizes"], len(ids)).astype(np.int64)))
    raw = np.frombuffer(pa.decompress(row["text"], int(row["bytes"]), codec="zstd", asbytes=True), np.uint8)
    numbers = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    tiles = Tiles(raw, bounds, np.array([i is not None for i in ids], dtype=bool))
    tiles.sort(numbers)
    return ids, numbers, raw, bounds, tiles


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """k-grams have 48 bits; ranges are as wide as each other."""
    return (grams >> 16) * ranges >> 32


def _parts(groups: np.ndarray) -> list[tuple[int, slice]]:
    """Equal neighbours as slices."""
    heads = np.flatnonzero(np.diff(groups, prepend=-1) != 0)
    return [(int(groups[a]), slice(a, b)) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(groups)])]


def _pack_ids(ids: np.ndarray) -> tuple[int, bytes]:
    least = int(ids.min(initial=np.iinfo(np.int64).max))
    return least, pack((ids - least).astype(np.uint64))


def _unpack_ids(least: int, data: bytes, n: int) -> np.ndarray:
    return unpack(data, n).astype(np.int64) + int(least)


_NAMED = "range long, shard long, n long, grams binary, hashes binary, kinds binary, least long, ids binary"


def _named(ranges: int):
    """Per range: a shard's k-grams, how many tiles each comes with, one's hash, and the least id."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *_, tiles = _load(row)
                at = tiles.grams
                if not len(at):
                    continue
                last = np.append(at[1:], len(tiles.gram)) - 1
                kinds = tiles.of_tile[last] - tiles.of_tile[at] + 1
                least, most = np.minimum.reduceat(tiles.id, at), np.maximum.reduceat(tiles.id, at)
                grams, hashes = tiles.gram[at], tiles.hash[at].view(np.uint64) >> np.uint64(24)
                for number, s in _parts(_range_of(grams, ranges)):
                    first, ids = _pack_ids(least[s])
                    columns = [
                        pa.array([number]), pa.array([row["shard"]]), pa.array([s.stop - s.start]),
                        pa.array([pack_keys(grams[s].astype(np.uint64))], pa.binary()),
                        pa.array([pack(hashes[s])], pa.binary()),
                        pa.array([pack((2 * kinds + (most > least))[s])], pa.binary()),
                        pa.array([first]), pa.array([ids], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _NAMED.split(", ")])

    return scan


_ANSWERED = "shard long, range long, n long, states binary, lots binary, n_lots long"


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """One range: what each shard's k-grams are, and into how many parts the lots of the range are split."""
    group = group.sort_values("shard")
    sizes = group["n"].tolist()
    grams = np.concatenate([unpack_keys(x, n) for x, n in zip(group["grams"], sizes)]).astype(np.int64)
    hashes = np.concatenate([unpack(x, n) for x, n in zip(group["hashes"], sizes)])
    kinds = np.concatenate([unpack(x, n) for x, n in zip(group["kinds"], sizes)]).astype(np.int64)
    ids = np.concatenate([_unpack_ids(b, x, n) for b, x, n in zip(group["least"], group["ids"], sizes)])
    order = np.argsort(grams, kind="stable")
    heads = np.flatnonzero(np.diff(grams[order], prepend=-1) != 0)
    of = np.empty(len(grams), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(grams)))
    least, most = np.minimum.reduceat(ids[order], heads), np.maximum.reduceat(ids[order], heads)
    several = (least < most) | np.logical_or.reduceat((kinds & 1 > 0)[order], heads)
    hash_of = hashes[order][heads]
    differ = np.logical_or.reduceat(((kinds > 3) | (hashes != hash_of[of]))[order], heads)
    contested = (several & differ)[of]
    states = np.where(contested, CONTESTED, np.where(least[of] < ids, EARLIER, FREE)).astype(np.uint8)
    # Lots are ranges of k-grams; the tiles around one k-gram may need several parts.
    size = (kinds >> 1) * (LENGTH + REACH // 2 + 1) * contested
    lots = max(1, int(-(-size.sum() // LOT)))
    held = np.bincount(_lot_of(grams, lots), weights=size, minlength=lots)
    splits = pack(np.maximum(1, np.ceil(held / (2 * LOT))).astype(np.uint64))
    cuts = np.append(0, np.cumsum(sizes))
    return pd.DataFrame(
        {
            "shard": group["shard"],
            "range": group["range"],
            "n": sizes,
            "states": [pa.compress(states[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])],
            "lots": [splits] * len(group),
            "n_lots": [lots] * len(group),
        }
    )


def _lot_of(grams: np.ndarray, lots: int) -> np.ndarray:
    return (mix(grams.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) * lots >> 32


def _states(tiles: Tiles, answers: pd.DataFrame) -> np.ndarray:
    """Per k-gram of the shard."""
    parts = [
        np.frombuffer(pa.decompress(x, int(n), codec="zstd", asbytes=True), np.uint8)
        for x, n in zip(answers["states"], answers["n"])
    ]
    return np.concatenate([np.zeros(0, np.uint8), *parts])


def _contested(shard: int, tiles: Tiles, answers: pd.DataFrame) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Range, lot, part, parts and tiles (the first of those that are equal) of what is to be told apart, and the tiles' lots.

    The lots of a range that are whole come together, in order, under ``WHOLE``.
    """
    answers = answers.sort_values("range")
    states = _states(tiles, answers)
    wanted = tiles.tiles[states[tiles.of_gram[tiles.tiles]] == CONTESTED]
    upto = np.searchsorted(tiles.of_gram[wanted], np.append(0, np.cumsum(answers["n"].to_numpy(np.int64))))
    for number, splits, lots, a, b in zip(answers["range"], answers["lots"], answers["n_lots"], upto, upto[1:]):
        own = wanted[a:b]
        if not len(own):
            continue
        lot, splits = _lot_of(tiles.gram[own], int(lots)), unpack(splits, int(lots)).astype(np.int64)
        part = (mix((tiles.hash[own] ^ shard).view(np.uint64)) >> np.uint64(40)).astype(np.int64) % splits[lot]
        group = np.where(splits[lot] > 1, 1 + lot * (int(splits.max()) + 1) + part, 0)
        order = np.lexsort((lot, group))
        for found, s in _parts(group[order]):
            some = order[s]
            first = some[0]
            named = (int(lot[first]), int(part[first]), int(splits[lot[first]])) if found else (WHOLE, 0, 1)
            yield int(number), *named, own[some], lot[some]


_TILES = (
    "range long, lot long, part long, parts long, shard long, n long, bytes long, lots binary, counts binary, "
    "least long, ids binary, text binary"
)


def _ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One shard: the bytes of its contested tiles."""
    names = [x.split()[0] for x in _TILES.split(", ")]
    rows = []
    if len(left) and len(right):
        row = left.iloc[0]
        *_, raw, _, tiles = _load(row)
        for number, lot, part, parts, own, lots in _contested(int(row["shard"]), tiles, right):
            text = raw[_ragged(tiles.first[own], tiles.count[own] + LENGTH - 1)].tobytes()
            least, ids = _pack_ids(tiles.id[own])
            packed = pa.compress(text, codec="zstd", asbytes=True)
            lots, counts = pack_keys(lots.astype(np.uint64)), pack(tiles.count[own])
            rows.append((number, lot, part, parts, row["shard"], len(own), len(text), lots, counts, least, ids, packed))
    return pd.DataFrame(rows, columns=names)


def _sorted_with_places(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """The order by two numbers; ``bits`` of the high and the low one together."""
    n = len(high)
    room = max(1, (n - 1).bit_length())
    if bits + room <= 63:  # sorted as single numbers, with the place in the lowest bits
        low_bits = bits - max(1, int(high.max(initial=0)).bit_length())
        packed = (high << low_bits | low) << room | np.arange(n)
        return np.sort(packed) & ((1 << room) - 1)
    return np.lexsort((low, high))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order (Larsson and Sadakane). Zeros end texts, the last one too; a zero further left is the smaller one.

    Suffixes start in groups of equal beginnings. While ``far`` symbols are told apart, the
    rank of the suffix ``far`` places on sorts a group by twice as many; groups of one are left alone.
    """
    n = len(symbols)
    far = 4
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    padded = np.concatenate([symbols, np.zeros(far, dtype=symbols.dtype)])
    for k in range(far):
        symbol = padded[k : k + n]
        key = key << 9 | np.where(alive, symbol, 0)
        alive &= symbol != 0
    order = _sorted_with_places(key, np.zeros(n, dtype=np.int64), max(1, int(key.max(initial=0)).bit_length()))
    # Each zero is one of its kind, so what reaches one stands alone, in order of place.
    new = (np.diff(key[order], prepend=-1) != 0) | ~alive[order]
    rank = np.empty(n, dtype=np.int64)
    while True:
        heads = np.flatnonzero(new)
        group = np.repeat(heads, np.diff(heads, append=n))  # the first place of each one's group
        rank[order] = group
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            return order
        at = order[open_]
        beyond = rank[at + far]
        bits = max(1, int(group[open_].max()).bit_length()) + max(1, int(beyond.max()).bit_length())
        again = _sorted_with_places(group[open_], beyond, bits)
        order[open_], beyond = at[again], beyond[again]
        # Groups keep their places, so a new group begins where the rank beyond changes.
        new[open_[1:]] |= beyond[1:] != beyond[:-1]
        far *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix of ``order`` has in common with the one before it, zeros apart (Kasai).

    From one place of the text to the next, a suffix loses at most one common symbol. Runs
    of places go on side by side, a place at a time.
    """
    n = len(symbols)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    run = 64
    heads = np.arange(0, n, run)
    common = np.zeros(len(heads), dtype=np.int64)
    for step in range(min(run, n)):
        if heads[-1] + step >= n:
            heads, common = heads[:-1], common[:-1]
        at = heads + step
        partner = before[at]
        common = np.where(partner < 0, 0, np.maximum(common - 1, 0))
        live = np.flatnonzero(partner >= 0)
        while len(live):
            symbol = symbols[at[live] + common[live]]
            live = live[(symbol == symbols[partner[live] + common[live]]) & (symbol != 0)]
            common[live] += 1
        out[at] = common
    return out[order]


def _tiles_in(rows: pd.DataFrame) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text of some rows' tiles, where in it each begins and ends, and the ids."""
    sizes = rows["n"].tolist()
    count = np.concatenate([unpack(x, n) for x, n in zip(rows["counts"], sizes)]).astype(np.int64)
    ids = np.concatenate([_unpack_ids(b, x, n) for b, x, n in zip(rows["least"], rows["ids"], sizes)])
    text = b"".join([pa.decompress(x, int(n), codec="zstd", asbytes=True) for x, n in zip(rows["text"], rows["bytes"])])
    ends = np.cumsum(count + LENGTH - 1)
    return text, ends - (count + LENGTH - 1), ends, ids


class Strings:
    """All strings of the tiles of a lot: which are equal, and the least id that has each. Equal tiles are looked at once."""

    def __init__(self, text: bytes, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        tiles = np.empty(len(ids), dtype=object)
        tiles[:] = [text[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        self.of, different = pd.factorize(tiles)
        self.id, length = ids, np.array([len(tile) for tile in different], dtype=np.int64)
        least = np.full(len(different), np.iinfo(np.int64).max)
        np.minimum.at(least, self.of, ids)
        self.count = length - LENGTH + 1
        raw = np.frombuffer(b"".join(different), np.uint8)
        # Bytes as 1 to 256; a zero ends each tile.
        begin = np.cumsum(length + 1) - (length + 1)
        symbols = np.zeros(int((length + 1).sum()), dtype=np.int16)
        symbols[_ragged(begin, length)] = raw.astype(np.int16) + 1
        order = suffix_array(symbols)
        common = common_prefixes(symbols, order)
        starts = _ragged(begin, self.count)  # of all strings
        string_at = np.full(len(symbols), -1, dtype=np.int64)
        string_at[starts] = np.arange(len(starts))
        # Equal strings follow each other; what has less than LENGTH bytes left shares less with any.
        kind = np.cumsum(common < LENGTH) - 1
        found = string_at[order]
        whole = found >= 0
        kinds, kind = np.unique(kind[whole], return_inverse=True)
        self.kind = np.empty(len(starts), dtype=np.int64)
        self.kind[found[whole]] = kind
        self.least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.kind, np.repeat(least, self.count))
        head = np.zeros(len(kinds), dtype=np.int64)
        head[self.kind] = np.arange(len(starts))
        self.symbols, self.heads = symbols, starts[head]  # a place of each, in order

    def lines(self) -> np.ndarray:
        """The different strings in order, as fixed numbers of bytes."""
        bytes_ = (self.symbols[self.heads[:, None] + np.arange(LENGTH)] - 1).astype(np.uint8)
        return np.ascontiguousarray(bytes_).view(f"V{LENGTH}").ravel()

    def masks(self, least: np.ndarray) -> np.ndarray:
        """Per tile a bit for each of its strings that stands in a document with a smaller id."""
        count, first = self.count[self.of], (np.cumsum(self.count) - self.count)[self.of]
        begins = np.cumsum(count) - count
        gone = least[self.kind[_ragged(first, count)]] < np.repeat(self.id, count)
        bit = np.arange(len(gone)) - np.repeat(begins, count)
        return np.add.reduceat(gone.astype(np.int64) << bit, begins)


_TOLD = "shard long, range long, lot long, part long, n long, masks binary"


def _told(rows: pd.DataFrame, masks: np.ndarray) -> pd.DataFrame:
    cuts = np.append(0, np.cumsum(rows["n"].to_numpy(np.int64)))
    out = rows[["shard", "range", "lot", "part", "n"]].copy()
    out["masks"] = [pack(masks[a:b].astype(np.uint64)) for a, b in zip(cuts, cuts[1:])]
    return out


def _tell(group: pd.DataFrame) -> pd.DataFrame:
    """The lots of a range that are whole, one after the other."""
    group = group.sort_values("shard").reset_index(drop=True)
    text, begins, ends, ids = _tiles_in(group)
    lots = np.concatenate([unpack_keys(x, n) for x, n in zip(group["lots"], group["n"].tolist())]).astype(np.int64)
    masks, order = np.zeros(len(ids), dtype=np.int64), np.argsort(lots, kind="stable")
    for _, s in _parts(lots[order]):
        some = order[s]
        found = Strings(text, begins[some], ends[some], ids[some])
        masks[some] = found.masks(found.least)
    return _told(group, masks)


_LISTED = "range long, lot long, slice long, part long, n long, lines binary, least long, ids binary"


def _slice_of(lines: np.ndarray, slices: int) -> np.ndarray:
    eight = np.ascontiguousarray(lines.view(np.uint8).reshape(-1, LENGTH)[:, : LENGTH // 8 * 8]).view(np.uint64)
    out = np.zeros(len(lines), dtype=np.uint64)
    for column in eight.T:
        out = mix(out + column)
    return ((out >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _list(group: pd.DataFrame) -> pd.DataFrame:
    """A part of a lot: its strings in the order of its suffix array, dealt to slices."""
    group = group.sort_values("shard")
    found = Strings(*_tiles_in(group))
    row, lines = group.iloc[0], found.lines()
    slice_ = _slice_of(lines, int(row["parts"]))
    order = np.argsort(slice_, kind="stable")
    rows = []
    for number, s in _parts(slice_[order]):
        some = order[s]
        least, ids = _pack_ids(found.least[some])
        packed = pa.compress(lines[some].tobytes(), codec="zstd", asbytes=True)
        rows.append((row["range"], row["lot"], number, row["part"], len(some), packed, least, ids))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _LISTED.split(", ")])


_MERGED = "range long, lot long, part long, slice long, n long, least long, ids binary"


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """One slice of a lot: each part's list is looked up, by binary search, in the list merged so far."""
    group = group.sort_values("part")
    lists = []
    for lines, n in zip(group["lines"], group["n"]):
        raw = pa.decompress(lines, int(n) * LENGTH, codec="zstd", asbytes=True)
        lists.append(np.frombuffer(raw, f"S{LENGTH}"))
    ids = [_unpack_ids(b, x, n) for b, x, n in zip(group["least"], group["ids"], group["n"])]
    merged, least = lists[0], ids[0].copy()
    for lines, own in zip(lists[1:], ids[1:]):
        at = np.searchsorted(merged, lines)
        has = at < len(merged)
        has[has] = merged[at[has]] == lines[has]
        least[at[has]] = np.minimum(least[at[has]], own[has])
        merged, least = np.insert(merged, at[~has], lines[~has]), np.insert(least, at[~has], own[~has])
    rows = []
    for row, lines in zip(group.itertuples(index=False), lists):
        first, packed = _pack_ids(least[np.searchsorted(merged, lines)])
        rows.append((row.range, row.lot, row.part, row.slice, row.n, first, packed))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _MERGED.split(", ")])


def _tell_part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A part of a lot, with what the merged lists say."""
    left = left.sort_values("shard").reset_index(drop=True)
    found = Strings(*_tiles_in(left))
    slice_ = _slice_of(found.lines(), int(left["parts"].iloc[0]))
    least = np.empty(len(slice_), dtype=np.int64)
    for row in right.itertuples(index=False):
        least[slice_ == row.slice] = _unpack_ids(row.least, row.ids, row.n)
    return _told(left, found.masks(least))


_RESULT = "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One shard: what is removed from its documents."""
    row = left.iloc[0]
    ids, _, raw, bounds, tiles = _load(row)
    answers = right[right["states"].notna()].sort_values("range")
    gone = np.zeros(len(tiles.tiles), dtype=np.int64)  # bits, per different tile, for the least id
    if len(answers):
        states = _states(tiles, answers)[tiles.of_gram[tiles.tiles]]
        gone[states == EARLIER] = -1
        told = right[right["masks"].notna()].set_index(["range", "lot", "part"])["masks"].to_dict()
        for number, lot, part, _, own, _ in _contested(int(row["shard"]), tiles, answers):
            gone[tiles.of_tile[own]] = unpack(told[number, lot, part], len(own)).astype(np.int64)
    mask = np.where(tiles.id > tiles.id[tiles.tiles][tiles.of_tile], -1, gone[tiles.of_tile]) if len(tiles.id) else gone
    some = np.flatnonzero(mask)
    where = np.repeat(some, tiles.count[some])
    bit = np.arange(len(where)) - np.repeat(np.cumsum(tiles.count[some]) - tiles.count[some], tiles.count[some])
    removed = mask[where] >> bit & 1 > 0
    depth = np.zeros(len(raw) + 1, dtype=np.int32)
    starts = (tiles.first[where] + bit)[removed]
    depth[starts] += 1
    depth[starts + LENGTH] -= 1
    covered = np.cumsum(depth[:-1]) > 0
    rows = []
    for id_, a, b in zip(ids, bounds.tolist(), bounds[1:].tolist()):
        own = covered[a:b]
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        kept = raw[a:b][~own] if len(edges) else raw[a:b]
        rows.append((id_, b - a, [{"start": x, "end": y} for x, y in edges.tolist()], kept.tobytes()))
    out = pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])
    return out.assign(id=out["id"].astype("Int64"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (start and end of what is removed) and ``kept``.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also begins in a document with a
    smaller id; strings are judged on the texts as they come. Rows with equal ids remove
    nothing from each other. Rows with a null id remove nothing and lose nothing. Null and
    empty texts have no bytes. ``kept`` is binary, since a span may end inside a character.
    Spans are in order and do not touch. No documents give no rows. Other columns are not read.

    K-grams are told apart by 48 bits of hash and, where only one tile comes with a k-gram, tiles by 40
    more; tiles that differ are compared byte by byte.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    shards = stage(
        texts.mapInArrow(_shards, "shard long, ids array<long>, sizes binary, bytes long, text binary"), "shards"
    )
    total = shards.agg(F.sum("bytes")).first()[0] or 0
    grams = total // (REACH // 2)
    ranges = 1 + grams // min(WIDEST, max(RANGE, grams // RANGES))
    named = shards.mapInArrow(_named(ranges), _NAMED)
    answers = stage(named.groupBy("range").applyInPandas(_answer, _ANSWERED), "answers")
    asked = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(_ask, _TILES)
    asked = stage(asked, "tiles")
    told = asked.where(F.col("lot") == WHOLE).groupBy("range").applyInPandas(_tell, _TOLD)
    large = asked.where(F.col("lot") != WHOLE)
    keys = ["range", "lot", "part"]
    listed = large.groupBy(*keys).applyInPandas(_list, _LISTED)
    merged = listed.groupBy("range", "lot", "slice").applyInPandas(_merge, _MERGED)
    told = told.unionByName(large.groupBy(*keys).cogroup(merged.groupBy(*keys)).applyInPandas(_tell_part, _TOLD))
    known = answers.withColumns({"lot": F.lit(None).cast("long"), "part": F.lit(None).cast("long"), "masks": F.lit(None).cast("binary")})
    known = known.unionByName(told.withColumns({c: F.lit(None).cast(t) for c, t in (("states", "binary"), ("lots", "binary"), ("n_lots", "long"))}))
    found = shards.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_finish, _RESULT)
    return found.withColumnRenamed("id", id_col)
