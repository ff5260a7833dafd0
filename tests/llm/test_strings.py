"""op11, op12 and op13 against plain versions on small tables."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import alignment, queries, suffixes
from tillroll.llm.alignment import Cuts, Vocabularies, align_tokens, gallop, parts
from tillroll.llm.periodic import Catchers, collapse_runs, find_runs
from tillroll.llm.suffixes import common_prefixes, remove_repeats, suffix_array

A, B = (f"{queries.TOKENIZERS}/{name}" for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, id int, n int, runs string, shard long, block long"


def docs_of(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (None, "a null id, " * 20), (3, " "), (4, "\n\t "), (5, "x"), (5, "x"), (6, "é \U0001f600 ß ﬁ a b")]


@pytest.fixture(scope="module")
def vocabularies():
    with open(A, "rb") as a, open(B, "rb") as b:
        return Vocabularies(a.read(), b.read())


def plain_alignment(vocabularies, rows):
    found, counts = [], Counter()
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        (a,), (b,), (same,) = vocabularies.encode([text])
        if not same:
            found.append(None)
            continue
        ends = [np.cumsum(size[np.array(x)]).tolist() for x, size in ((a, vocabularies.lengths_a), (b, vocabularies.lengths_b))]
        links = [
            (x, y) for k, x in enumerate(a) for m, y in enumerate(b)
            if max([0, *ends[0]][k], [0, *ends[1]][m]) < min(ends[0][k], ends[1][m])
        ]
        groups, p, q = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p2, q2 = (bisect.bisect_right(e, end) for e in ends)
            groups.append(",".join(map(str, a[p:p2])) + "|" + ",".join(map(str, b[q:q2])))
            p, q = p2, q2
        found.append((len(a), len(b), groups, links))
        counts.update(set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (id_, _), f in zip(rows, found):
        if f is None:
            out.append((id_, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        best = sum(counts[x] == most[x[0]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((id_, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return out


def key(row):
    return tuple((x is None, x) if not isinstance(x, tuple) else x for x in row)


def same_rows(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_alignment_against_plain(spark, vocabularies):
    rng = random.Random(1)
    words = ["the", "model's", "été", "<|endoftext|>", "</s>", "12,345", "naïve", "  ", "\n\n", "don't", "日本語", "x" * 40, "(a)", "　"]
    rows = [*ODD, (7, "has a ▁ mark"), (8, "\x00 nul"), (9, "<0x41> <unk>"), (10, "  a \u0085b"), (-11, "the model's the")]
    rows += [(100 + n, rng.choice([" ", "  ", "\n "]).join(rng.choices(words, k=rng.randint(1, 60)))) for n in range(60)]
    rows += rows[-3:]
    got = align_tokens(docs_of(spark, rows), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same_rows(got.collect(), plain_alignment(vocabularies, rows))
    assert align_tokens(docs_of(spark, rows).limit(0), A, B).count() == 0


def test_alignment_in_parts(spark, vocabularies, monkeypatch):
    """A text aligned in many parts, and cuts forgotten in between, give the same."""
    monkeypatch.setattr(alignment, "PART", 300)
    monkeypatch.setattr(alignment, "KEPT", 50)
    rng = random.Random(2)
    rows = [(n, " ".join("".join(rng.choices("abcdeé,.", k=rng.randint(0, 9))) for _ in range(400))) for n in range(3)] + [(9, "y" * 2000)]
    same_rows(align_tokens(docs_of(spark, rows), A, B).collect(), plain_alignment(vocabularies, rows))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab's 1,.\n\té 　▁<|>endoftext日"), max_size=60))
def test_tokens_of_cuts_are_those_of_the_text(vocabularies, text):
    assert vocabularies.cuts
    if not text:
        return
    cuts = Cuts(vocabularies)
    found = np.concatenate([cuts.of(p) for p in parts(text)])
    cuts.encode(np.unique(found))
    for k, whole in enumerate(vocabularies.encode([text])[:2]):
        ids = [cuts.flat[k][a : a + n] for a, n in zip(cuts.first[k, found], cuts.count[k, found])]
        assert np.concatenate(ids).tolist() == whole[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 900), unique=True), st.lists(st.integers(0, 900), unique=True), st.integers(1, 9))
def test_gallop(short, long, run):
    short, long = np.array(sorted(short), dtype=np.int64), np.array(sorted(long), dtype=np.int64)
    if not len(short):
        return
    alignment.RUN, before = run, alignment.RUN
    try:
        rank, common = gallop(short, long)
    finally:
        alignment.RUN = before
    assert rank.tolist() == np.searchsorted(long, short).tolist()
    assert common.tolist() == np.isin(short, long).tolist()


def plain_runs(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        x = q
        while x < n:
            if words[x] != words[x - q]:
                x += 1
                continue
            begin = x
            while x < n and words[x] == words[x - q]:
                x += 1
            shorter = (r for r in range(1, q) if q % r == 0)
            repeats = any(all(words[i] == words[i - r] for i in range(begin - q + r, x)) for r in shorter)
            if x - begin + q >= max(least, times * q) and not repeats:
                out.append((begin - q, x - begin + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(max(1, n)), rng.randint(1, 15)
        for i in range(a, min(n, a + rng.randint(10, 90))):
            words[i] = words[a + (i - a) % p]
    return words


def test_catchers_against_plain():
    rng = random.Random(3)
    for _ in range(400):
        words = some_words(rng, rng.randint(0, 110))
        least, times = rng.choice([(24, 3), (4, 2), (6, 3), (2, 2), (1, 4)])
        want = plain_runs(words, least, times)
        assert find_runs([np.array(words, dtype=np.int64)], least, times) == [want]
        catchers, told, at = Catchers(len(words) // times, least, times), {}, 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 7, 30])
            told |= {(s, p): n for s, n, p in catchers.append(np.array(words[at : at + step], dtype=np.int64))}
            at += step
            # What is known after each word is what the words so far hold.
            have = sorted(((s, e - s, p) for (s, p), e in catchers.runs.items()), key=lambda r: (r[0], r[2]))
            assert have == [r for r in plain_runs(words[:at], least, times) if r[2] <= len(words) // times]
        assert told == {(s, p): n for s, n, p in want}


def test_runs_of_many_and_long_texts():
    rng = random.Random(4)
    texts = [np.array(some_words(rng, rng.randint(0, 200)), dtype=np.int64) for _ in range(60)]
    assert find_runs(texts, 24, 3) == [plain_runs(t.tolist()) for t in texts]
    assert find_runs([np.zeros(600_000, dtype=np.int64)], 24, 3) == [[(0, 600_000, 1)]]


def test_collapse_runs(spark):
    line = "again and  again\n"
    rows = [*ODD, (10, line * 12), (11, "Word word " * 12), (12, "a " * 23), (13, "a " * 24), (14, "x y " * 30)]
    got = collapse_runs(docs_of(spark, rows))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = {r.doc_id: r for r in got.collect() if r.doc_id != 5}
    assert got.count() == len(rows) and collapse_runs(docs_of(spark, rows).limit(0)).count() == 0
    assert (found[1].n_words, found[1].runs, found[1].collapsed) == (0, [], "") == (found[2].n_words, found[2].runs, found[2].collapsed)
    assert found[10].collapsed == "again and again" and tuple(found[10].runs[0]) == (0, 36, 3)
    assert found[11].collapsed == "Word word" and found[13].collapsed == "a" and found[12].runs == []
    assert found[14].collapsed == "x y" and found[None].collapsed == "a null id,"


def test_planted_runs_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(n, " ".join(map(str, some_words(rng, rng.randint(0, 120))))) for n in range(150)] + ODD
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for id_, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), crc32(str(id_).encode())
        if id_ is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        ratio = 1000 * best[1] // best[2] if runs else None
        want.append((id_, len(runs), *best, ratio, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    same_rows(queries.op12_periodic_runs(spark, str(tmp_path)).collect(), want)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 300)
        x = np.array([1 + rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(n)], dtype=np.int16)
        a, b, more = rng.randrange(n), rng.randrange(n), rng.randint(0, 90)
        more = min(n - max(a, b), more)
        x[a : a + more] = x[b : b + more].copy()
        x[[rng.randrange(n) for _ in range(rng.randint(0, 9))]] = 0
        x[-1] = 0
        ends = [next(j for j in range(i, n) if not x[j]) for i in range(n)]
        # Zeros are smaller than bytes, and the further left the smaller.
        order = sorted(range(n), key=lambda i: [int(v) + n for v in x[i : ends[i]]] + [ends[i]])
        got = suffix_array(x)
        assert got.tolist() == order
        shared = [0]
        for p, q in zip(order, order[1:]):
            k = 0
            while x[p + k] and x[p + k] == x[q + k]:
                k += 1
            shared.append(k)
        assert common_prefixes(x, got).tolist() == shared


def plain_removal(rows, length=suffixes.LENGTH):
    least, out = {}, []
    for id_, text in rows:
        raw = (text or "").encode()
        for j in range(len(raw) - length + 1) if id_ is not None else ():
            least[raw[j : j + length]] = min(id_, least.get(raw[j : j + length], id_))
    for id_, text in rows:
        raw = (text or "").encode()
        gone = set()
        for j in range(len(raw) - length + 1) if id_ is not None else ():
            if least[raw[j : j + length]] < id_:
                gone.update(range(j, j + length))
        spans = [(j, next(k for k in range(j, len(raw) + 1) if k not in gone)) for j in sorted(gone) if j - 1 not in gone]
        out.append((id_, len(raw), spans, bytes(c for j, c in enumerate(raw) if j not in gone)))
    return out


def repeated_texts(rng):
    def prose(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    shared = [prose(n) for n in (49, 50, 51, 70, 120, 400)]
    rows = [(n, prose(rng.randint(0, 80)) + rng.choice(shared) + prose(rng.randint(0, 80))) for n in range(120)]
    rows += [(200 + n, prose(30) + shared[4][n : n + 60] + shared[5][:200] + prose(5)) for n in range(40)]
    rows += [(-5, "z" * 300), (300, "z" * 120), (301, "zy" * 100), (302, "zy" * 90), (303, shared[5]), (303, shared[5]), (303, shared[4])]
    rng.shuffle(rows)
    return rows + [*ODD, (7, "é" * 26), (8, "é" * 25), (None, shared[5])]


@pytest.mark.parametrize("lot, shard, segment", [(1 << 19, 4 << 20, 1 << 15), (900, 2000, 300)])
def test_removal_against_plain(spark, monkeypatch, lot, shard, segment):
    """Also with shards and segments of a few texts, and lots that are split and merged again."""
    for name, value in (("LOT", lot), ("SHARD", shard), ("SEGMENT", segment)):
        monkeypatch.setattr(suffixes, name, value)
    monkeypatch.setattr(suffixes, "_tables", {})
    rows = repeated_texts(random.Random(7))
    got = remove_repeats(docs_of(spark, rows).repartition(3, "doc_id"))
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    found = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(plain_removal(rows), key=str)
    assert sum(len(s) for _, _, s, _ in found) > 100


def test_removal_without_documents_or_repeats(spark):
    assert remove_repeats(docs_of(spark, ODD).limit(0)).count() == 0
    rows = remove_repeats(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.spans == [] for r in rows)


def test_a_lot_of_one_hot_string_is_split(spark, monkeypatch):
    """Many different tiles around one line go to several parts."""
    monkeypatch.setattr(suffixes, "LOT", 4000)
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefghij ", k=64))
    rows = [(n, "".join(rng.choices("klmnopqrst", k=40)) + line + "".join(rng.choices("uvwxyz", k=40))) for n in range(900)]
    seen = []
    before = suffixes.stage
    monkeypatch.setattr(suffixes, "stage", lambda df, label: seen.append((label, before(df, label))) or seen[-1][1])
    found = remove_repeats(docs_of(spark, rows)).collect()
    assert dict(seen)["tiles"].agg({"parts": "max"}).first()[0] > 1
    assert {r.doc_id for r in found if r.spans} == set(range(1, 900))
    have = [(r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in found]
    assert sorted(have, key=str) == sorted(plain_removal(rows), key=str)


def test_a_shard_sends_a_row_for_each_range(spark, monkeypatch):
    """However many lots there are; before, rows grew with shards times lots. Ranges get wider where there are many."""
    for name, value in (("LOT", 900), ("SHARD", 2000), ("RANGE", 20), ("RANGES", 4), ("WIDEST", 200)):
        monkeypatch.setattr(suffixes, name, value, raising=False)
    seen, before = {}, suffixes.stage
    monkeypatch.setattr(suffixes, "stage", lambda df, label: seen.setdefault(label, before(df, label)))
    rows = repeated_texts(random.Random(9))
    got = remove_repeats(docs_of(spark, rows))
    found = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(plain_removal(rows), key=str)
    whole, answers = seen["tiles"].where("parts = 1"), seen["answers"]
    assert answers.agg({"n_lots": "max"}).first()[0] > 1 and whole.count() > 0
    assert whole.groupBy("shard", "range").count().agg({"count": "max"}).first()[0] == 1
    size = sum(len((text or "").encode()) for _, text in rows)
    assert 1 < answers.select("range").distinct().count() <= size // (15 * 200) + 1


def test_equal_tiles_of_a_lot_are_sorted_once():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 3, 400, dtype=np.uint8)
    tiles = [raw[a : a + n].tobytes() for a, n in ((0, 60), (10, 55), (200, 80), (3, 57))]
    some = rng.integers(0, len(tiles), 300)
    text, ids = b"".join(tiles[n] for n in some), rng.integers(0, 1000, 300)
    ends = np.cumsum([len(tiles[n]) for n in some])
    found = suffixes.Strings(text, ends - [len(tiles[n]) for n in some], ends, ids)
    assert len(found.symbols) == sum(len(tile) + 1 for tile in tiles)
    strings = [[tiles[n][k : k + 50] for k in range(len(tiles[n]) - 49)] for n in some]
    least = {}
    for own, id_ in zip(strings, ids.tolist()):
        least |= {x: min(id_, least.get(x, id_)) for x in own}
    want = [sum((least[x] < id_) << k for k, x in enumerate(own)) for own, id_ in zip(strings, ids.tolist())]
    assert found.masks(found.least).tolist() == want
