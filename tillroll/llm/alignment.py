"""Two tokenizers' tokens of the same texts, matched by the bytes they stand for.

1. Tokens: a text is cut before a space that has a character other than white space on both
   sides. Neither vocabulary has a token across such a place (looked up when they are loaded; if
   one had, texts would not be cut), so the tokens of a text are those of its cuts, and
   cuts that come often are encoded once.
2. Ends: both token lists become lists of byte offsets where tokens end. For each document the
   shorter list drives: an exponential and then a binary search from where the last one
   ended finds each of its ends in the longer list (all runs of ``RUN`` ends a step at a time).
   Common ends cut the tokens into groups; the ranks of neighbouring ends differ by the
   tokens of the other list that a token overlaps.
3. Corpus counts: documents are held in blocks of some ``BLOCK`` bytes. A block asks once for
   each of its different id pairs, with the number of its documents that link them, so a
   hot pair is one row per block; totals and each id's highest come from grouping those rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.katz import pack, pack_keys, unpack, unpack_keys
from tillroll.llm.words import group_sums, pieces
from tillroll.staging import stage

PART = 1 << 20  # characters aligned at a time
BLOCK = 4 << 20  # bytes of text in a block; a longer text is a block of its own
RUN = 128  # ends searched one after the other
LOT = 256  # cuts encoded together
KEPT = 300_000  # cuts whose tokens are kept
HELD = 8_000_000  # characters and tokens of all cuts kept
SPACE_MARK = "▁"
DIGITS = 7


def byte_of_letter() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, byte_level: bytes, sentence_pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=sentence_pieces)
        letters = byte_of_letter()
        vocabulary = self.a.get_vocab()
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, number in vocabulary.items():
            known = all(c in letters for c in token)
            self.bytes_a[number] = bytes(letters[c] for c in token) if known else token.encode()
        pieces_ = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces_)
        ]
        rules = json.loads(byte_level)
        before = rules["pre_tokenizer"] or {}
        # No token goes on from a character that is no space into a space.
        self.cuts = (
            rules["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces_)
        )
        self.lengths_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of space and text by A, of text by B, and whether both stand for the same bytes."""
        spaced = [f" {t}" for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = [
            b"".join(map(get_a, x)) == t.encode() == b"".join(map(get_b, y)) for t, x, y in zip(spaced, a, b, strict=True)
        ]
        return a, b, same


def _solid(c: str) -> bool:
    """White space by no definition."""
    return "!" <= c <= "~" or c.isalnum()


class Cuts:
    """Numbers for cuts, and the tokens of each."""

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies = vocabularies
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.edges = bytearray()  # 1: opens, 2: closes with a character that is no white space
        self.size = 0
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.first = np.full((2, 1024), -1, dtype=np.int64)
        self.count = np.zeros((2, 1024), dtype=np.int64)
        self.same = np.ones(1024, dtype=bool)

    def number(self, cut: str) -> int:
        found = self.numbers.get(cut)
        if found is None:
            found = self.numbers[cut] = len(self.names)
            self.names.append(cut)
            self.edges.append(_solid(cut[0]) + 2 * _solid(cut[-1]) if cut else 0)
            self.size += len(cut)
        return found

    def of(self, text: str) -> np.ndarray:
        """The numbers of the text's cuts (each stands for a space and the cut)."""
        if not self.vocabularies.cuts:
            return np.array([self.number(text)])
        parts = text.split(" ")
        found = list(map(self.numbers.get, parts))
        if None in found:
            found = [self.number(p) if n is None else n for n, p in zip(found, parts)]
        edge = np.frombuffer(self.edges, np.uint8)[found]
        clean = (edge[:-1] > 1) & (edge[1:] & 1 > 0)
        if not clean.all():
            at = [0, *(np.flatnonzero(clean) + 1).tolist(), len(parts)]
            found = [found[x] if y == x + 1 else self.number(" ".join(parts[x:y])) for x, y in zip(at, at[1:])]
        return np.array(found, dtype=np.int64)

    def encode(self, used: np.ndarray) -> None:
        """Find the tokens of the cuts that have none yet."""
        while len(self.names) > len(self.same):
            self.first = np.concatenate([self.first, np.full_like(self.first, -1)], axis=1)
            self.count = np.concatenate([self.count, np.zeros_like(self.count)], axis=1)
            self.same = np.concatenate([self.same, np.ones_like(self.same)])
        new = used[self.first[0, used] < 0]
        if not len(new):
            return
        # Cuts are encoded some LOT in a row, as the texts they come from would be.
        clean = np.array([self.edges[n] == 3 for n in new.tolist()])
        whole = new[clean].tolist() if self.vocabularies.cuts else []
        lots = [whole[i : i + LOT] for i in range(0, len(whole), LOT)]
        lots += [[n] for n in (new[~clean] if self.vocabularies.cuts else new).tolist()]
        while lots:
            lots = self._encode(lots)

    def _encode(self, lots: list[list[int]]) -> list[list[int]]:
        """The lots that have to be encoded one by one."""
        texts = [" ".join([self.names[n] for n in lot]) for lot in lots]
        again, held = [], ([self.flat[0]], [self.flat[1]])
        upto = [len(self.flat[0]), len(self.flat[1])]
        lengths = self.vocabularies.lengths_a, self.vocabularies.lengths_b
        for lot, *both, same in zip(lots, *self.vocabularies.encode(texts), strict=True):
            ids = [np.array(x, dtype=np.int32) for x in both]
            if len(lot) > 1:
                ends = np.cumsum([len(self.names[n].encode()) + 1 for n in lot])
                found = [np.searchsorted(np.cumsum(size[x]), ends) + 1 for size, x in zip(lengths, ids)]
                if not (same and all((np.append(0, np.cumsum(size[x]))[f] == ends).all() for size, x, f in zip(lengths, ids, found))):
                    again += [[n] for n in lot]
                    continue
            else:
                found = [np.array([len(x)]) for x in ids]
            self.same[lot] = same
            for k in (0, 1):
                self.first[k, lot] = upto[k] + np.append(0, found[k][:-1])
                self.count[k, lot] = np.diff(found[k], prepend=0)
                held[k].append(ids[k])
                upto[k] += len(ids[k])
                self.size += len(ids[k])
        self.flat = [np.concatenate(x) for x in held]
        return again

    def tidy(self) -> None:
        if len(self.names) > KEPT or self.size > HELD:
            self.clear()


def parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut at such a space as the cuts are (the space belongs to neither)."""
    begin = 0
    while len(text) - begin > 2 * PART:
        at = text.find(" ", begin + PART)
        while at >= 0 and not (_solid(text[at - 1]) and _solid(text[at + 1 : at + 2] or " ")):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at + 1
    yield text[begin:] if begin else text


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of ``short`` how many of ``long`` are smaller, and whether it is in ``long``.

    Both ascend. Runs of ``short`` begin where a binary search puts them; from there each number is
    looked for 1, 2, 4, ... places on from the last one's place, then between the last two looks.
    """
    n, m = len(short), len(long)
    rank = np.empty(n, dtype=np.int64)
    looked = np.append(long, np.iinfo(np.int64).max)
    heads = np.arange(0, n, RUN)
    place = np.searchsorted(long, short[heads])
    for step in range(min(RUN, n)):
        if heads[-1] + step >= n:
            heads, place = heads[:-1], place[:-1]
        at = heads + step
        value = short[at]
        low, high = place, np.empty_like(place)
        live, width = np.arange(len(at)), 1
        while len(live):  # all before low are smaller; look where the width would end
            look = np.minimum(low[live] + width - 1, m)
            less = looked[look] < value[live]
            high[live[~less]] = look[~less]
            live = live[less]
            low[live] += width
            width *= 2
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = looked[middle] < value[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        rank[at] = low
    return rank, looked[rank] == short


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for counts[0] places, then first[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


class Aligned:
    """The alignment of two token lists of some documents, end to end."""

    def __init__(self, ids_a, ends_a, ids_b, ends_b, counts_a, counts_b):
        """``counts``: tokens per document. Documents end at common ends."""
        docs = len(counts_a)
        drives = counts_a <= counts_b  # whether A's list is the shorter one
        short, long = np.minimum(counts_a, counts_b), np.maximum(counts_a, counts_b)
        first_a, first_b = np.cumsum(counts_a) - counts_a, np.cumsum(counts_b) - counts_b
        # Each document's shorter list, and each one's longer, end to end.
        self.side = np.repeat(drives, short)  # whether the shorter list is A's
        self.other = np.repeat(~drives, long)  # whether the longer one is
        all_ids, all_ends = np.concatenate([ids_a, ids_b]), np.concatenate([ends_a, ends_b])
        from_a, from_b = first_a, first_b + len(ids_a)
        take = _ragged(np.where(drives, from_a, from_b), short)
        self.short, ends_short = all_ids[take].astype(np.int64), all_ends[take]
        take = _ragged(np.where(drives, from_b, from_a), long)
        self.long, ends_long = all_ids[take].astype(np.int64), all_ends[take]
        rank, common = gallop(ends_short, ends_long)
        self.common = common
        self.common_long = np.zeros(len(self.long), dtype=bool)
        self.common_long[rank[common]] = True
        # A token overlaps what lies between the rank of the end before it and that of its own end.
        self.first = np.zeros(len(rank), dtype=np.int64)
        self.first[1:] = rank[:-1] + common[:-1]
        self.overlaps = rank - self.first + 1
        self.doc_short = np.repeat(np.arange(docs), short)
        self.groups = np.bincount(self.doc_short, weights=common, minlength=docs).astype(np.int64)
        self.links = np.bincount(self.doc_short, weights=self.overlaps, minlength=docs).astype(np.int64)
        self.tokens = counts_a + counts_b

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and id pair (as one number) of each link."""
        one = np.repeat(np.arange(len(self.short)), self.overlaps)
        x, y = self.short[one], self.long[_ragged(self.first, self.overlaps)]
        return self.doc_short[one], np.where(self.side[one], x * size_b + y, y * size_b + x)

    def text(self, digits: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents' groups as ``a1,a2|b1;``, and where each document's end."""
        n, m = len(self.short), len(self.long)
        of_short = np.cumsum(self.common) - self.common
        of_long = np.cumsum(self.common_long) - self.common_long
        ends_short = np.append(0, np.flatnonzero(self.common) + 1)
        ends_long = np.append(0, np.flatnonzero(self.common_long) + 1)
        ids, last_a = np.empty(n + m, dtype=np.int64), np.empty(n + m, dtype=bool)
        mark = np.full(n + m, ord(","), dtype=np.uint8)
        for own, side, group, last, others in (
            (self.short, self.side, of_short, self.common, ends_long),
            (self.long, self.other, of_long, self.common_long, ends_short),
        ):
            # A's tokens of a group come before B's.
            at = np.arange(len(own)) + others[group + ~side]
            ids[at] = own
            mark[at[last]] = np.where(side[last], ord("|"), ord(";"))
        upto = np.cumsum(lengths[ids] + 1)
        out = np.empty(upto[-1] if len(upto) else 0, dtype=np.uint8)
        out[upto - 1] = mark
        for k in range(DIGITS):
            has = np.flatnonzero(lengths[ids] > k)
            if not len(has):
                break
            out[upto[has] - 2 - k] = digits[ids[has], k]
        return out, np.append(0, upto)[np.cumsum(self.tokens)]


def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0, 1, ..., the last first, and how many there are."""
    numbers = np.arange(size)
    if size > 10**DIGITS:
        raise ValueError("token ids have too many digits")
    digits = np.stack([48 + numbers // 10**k % 10 for k in range(DIGITS)], axis=1).astype(np.uint8)
    lengths = np.maximum(1, np.stack([numbers >= 10**k for k in range(DIGITS)], axis=1).sum(axis=1))
    return digits, lengths


_DOCS = (
    "array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string, entries: long>>"
)
_BLOCK = f"block long, docs {_DOCS}, n_pairs long, n_entries long, pairs binary, ranks binary, times binary"


def _blocks(byte_level: bytes, sentence_pieces: bytes):
    """Blocks of documents: counts and digests, and the id pairs each document links, how often."""
    struct = pa.struct(
        [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        + [("sha", pa.string()), ("entries", pa.int64())]
    )

    def scan(batches) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies(byte_level, sentence_pieces)
        cuts = Cuts(vocabularies)
        digits, lengths = _decimal(max(vocabularies.size_a, vocabularies.size_b))
        number = TaskContext.get().partitionId() << 24
        span = vocabularies.size_a * vocabularies.size_b
        for piece in pieces(batches, most=BLOCK):
            ids = piece.column("id").to_pylist()
            block = _Block(len(ids), span, vocabularies.size_b, digits, lengths)
            lots, held = [], 0

            def align():
                block.add(lots, cuts)
                lots.clear()
                cuts.tidy()

            for at, text in enumerate(piece.column("text").to_pylist()):
                if not text:
                    continue
                for part in parts(text) if vocabularies.cuts else [text]:
                    lots.append((at, cuts.of(part)))
                    held += len(part)
                    if held >= PART:
                        align()
                        held = 0
            align()
            docs, columns = block.finish(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([docs], pa.list_(struct))]
                + [pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in columns],
                names=["block", "docs", "n_pairs", "n_entries", "pairs", "ranks", "times"],
            )
            number += 1

    return scan


class _Block:
    def __init__(self, docs: int, span: int, size_b: int, digits: np.ndarray, lengths: np.ndarray):
        if docs * span >= 1 << 62:
            raise ValueError("id pairs and documents of a block do not fit a number")
        self.span, self.size_b, self.digits, self.lengths = span, size_b, digits, lengths
        self.sums = np.zeros((4, docs), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.wrong = np.zeros(docs, dtype=bool)
        self.hashes: dict[int, tuple] = {}
        self.links: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, lots: list[tuple[int, np.ndarray]], cuts: Cuts) -> None:
        if not lots:
            return
        docs = np.array([at for at, _ in lots])
        sizes = np.array([len(found) for _, found in lots])
        used = np.concatenate([found for _, found in lots])
        cuts.encode(np.unique(used))
        lot = np.repeat(np.arange(len(lots)), sizes)
        self.wrong[docs[lot[~cuts.same[used]]]] = True
        right = ~self.wrong[docs[lot]]
        sides = []
        for k, lengths in enumerate((cuts.vocabularies.lengths_a, cuts.vocabularies.lengths_b)):
            keep = cuts.count[k, used] * right
            ids = cuts.flat[k][_ragged(cuts.first[k, used], keep)]
            sides += [ids, np.cumsum(lengths[ids]), np.bincount(lot, weights=keep, minlength=len(lots)).astype(np.int64)]
        ids_a, ends_a, counts_a, ids_b, ends_b, counts_b = sides
        if not len(ids_a):
            return
        found = Aligned(ids_a, ends_a, ids_b, ends_b, counts_a, counts_b)
        for row, values in zip(self.sums, (counts_a, counts_b, found.groups, found.links), strict=True):
            np.add.at(row, docs, values)
        of, pairs = found.pairs(self.size_b)
        links, times = np.unique(docs[of] * self.span + pairs, return_counts=True)
        self.links.append(links)
        self.times.append(times)
        text, ends = found.text(self.digits, self.lengths)
        begin = 0
        for at, end in zip(docs.tolist(), ends.tolist()):
            if end > begin:
                # The last mark of a document is left out, so it waits for more of it.
                hash_, open_ = self.hashes.get(at) or (hashlib.sha256(), b"")
                hash_.update(open_)
                hash_.update(text[begin : end - 1])
                self.hashes[at] = hash_, b";"
            begin = end

    def finish(self, ids: list) -> tuple[list[dict], tuple]:
        self.sums[:, self.wrong] = 0
        links = np.concatenate([*self.links, np.zeros(0, np.int64)])
        times = np.concatenate([*self.times, np.zeros(0, np.int64)])
        doc, pair = np.divmod(links, self.span)
        keep = ~self.wrong[doc]
        doc, pair, times = doc[keep], pair[keep], times[keep]
        pairs, at = np.unique(pair, return_inverse=True)
        order = np.argsort(-np.bincount(at, minlength=len(pairs)), kind="stable")  # frequent pairs get small numbers
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        entry, where = np.unique(doc * max(1, len(pairs)) + rank[at], return_inverse=True)
        times = np.bincount(where, weights=times, minlength=len(entry)).astype(np.uint64)
        doc, rank = np.divmod(entry, max(1, len(pairs)))
        counts = np.bincount(doc, minlength=len(ids))
        # Numbers of a document in order, as differences.
        step = np.diff(rank, prepend=0)
        heads = (np.cumsum(counts) - counts)[counts > 0]
        step[heads] = rank[heads]
        rows = [
            {
                "doc_id": id_, "n_a": a, "n_b": b, "n_groups": g, "n_links": n, "entries": c,
                "sha": self.hashes[i][0].hexdigest() if n else "",
            }
            for i, (id_, a, b, g, n, c) in enumerate(zip(ids, *self.sums.tolist(), counts.tolist(), strict=True))
        ]
        by_key = np.argsort(order)  # pairs stand in order of their keys, with their places
        packed = (
            pack_keys(pairs.astype(np.uint64)) + pack(by_key) if len(pairs) else b"",
            zlib.compress(pack(step), 1),
            zlib.compress(pack(times), 1),
        )
        return rows, (len(pairs), len(entry), *packed)


def _pairs_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id pairs of a block in order, and per entry the place of its pair and how often it is linked."""
    n, entries = int(row["n_pairs"]), int(row["n_entries"])
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    # The places take as many bytes each as the highest needs.
    width = max(1, ((n - 1).bit_length() + 7) // 8)
    cut = len(row["pairs"]) - width * n
    pairs = unpack_keys(row["pairs"][:cut], n).astype(np.int64)
    place = unpack(row["pairs"][cut:], n).astype(np.int64)
    key_at = np.empty(n, dtype=np.int64)
    key_at[place] = np.arange(n)
    counts = np.array([d["entries"] for d in row["docs"]])
    step = unpack(zlib.decompress(row["ranks"]), entries).astype(np.int64)
    upto = np.append(0, np.cumsum(step))
    begin = np.cumsum(counts) - counts
    rank = upto[1:] - np.repeat(upto[begin], counts)
    return pairs, key_at[rank], unpack(zlib.decompress(row["times"]), entries).astype(np.int64)


def _asked(batches) -> Iterator[pa.RecordBatch]:
    """Each different id pair of a block, and how many of its documents link it."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, at, _ = _pairs_of(row)
            n = np.bincount(at, minlength=len(pairs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs), pa.array(np.full(len(pairs), row["block"])), pa.array(n.astype(np.int64))],
                names=["pair", "block", "n"],
            )


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _told(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One block: what the corpus knows of its pairs, summed for each document."""
    row = left.iloc[0]
    pairs, at, times = _pairs_of(row)
    right = right.sort_values("pair")
    known = pd.DataFrame(list(row["docs"]))
    counts = known["entries"].to_numpy(np.int64)
    first = np.append(0, np.cumsum(counts))
    n, best = right["n"].to_numpy(np.int64), right["best"].to_numpy(bool)
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if i is None or i != i else int(i) for i in (d["doc_id"] for d in row["docs"])], "Int64"),
            **{c: known[c].astype("int64") for c in ("n_a", "n_b", "n_groups", "n_links")},
            "n_best": group_sums(times * best[at], first),
            "count_sum": group_sums(times * n[at], first),
            "groups_sha256": known["sha"],
        }
    )


def align_tokens(
    docs: DataFrame, byte_level: str, sentence_pieces: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``
    and ``groups_sha256``.

    ``byte_level`` and ``sentence_pieces`` are the files of A (byte-level BPE, JSON) and B (a piece
    model that puts a space before the text); only the driver reads them. Texts that are null,
    empty, no valid UTF-8, or not given back byte by byte by both vocabularies have no tokens: zeros, and an empty
    digest. Repeated rows count as documents of their own, null ids as well. No documents
    give no rows. Other columns are not read.
    """
    with open(byte_level, "rb") as a, open(sentence_pieces, "rb") as b:
        files = a.read(), b.read()
    size_b = Vocabularies(*files).size_b
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.is_valid_utf8(text), text).alias("text"))
    blocks = stage(texts.mapInArrow(_blocks(*files), _BLOCK), "aligned")
    asked = blocks.mapInArrow(_asked, "pair long, block long, n long")
    counts = stage(asked.groupBy("pair").agg(F.sum("n").alias("n")), "linked")
    counts = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("pair", "block").join(known, "pair")
    told = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_told, _RESULT)
    return told.withColumnRenamed("doc_id", id_col)
