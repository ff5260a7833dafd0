"""op3, op4 and op6 against plain versions."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import katz
from tillroll.llm.chat import BUDGET, chat_windows, read_back
from tillroll.llm.packing import best_fit, pack_documents

DOCS = "doc_id long, text string, source string, shard int, chunk long"


def plain_katz(rows):
    """Scores by dictionaries; also checks that probabilities after a context sum to one."""
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), b"</s>"] for _, t in rows]
    uni, bi, starts = collections.Counter(), collections.Counter(), sum(train)
    for w, learn in zip(tokens, train, strict=True):
        if learn:
            uni.update(w)
            bi.update(zip([b"<s>", *w], w, strict=False))
    tally = lambda c: [len(c), sum(c.values()), *(sum(v == r for v in c.values()) for r in range(1, 7))]
    low1, low2 = katz.discounted(tally(uni)), katz.discounted(tally(bi))
    less = lambda c, low: low[c] if c <= 5 else c - katz.TAIL
    n, unseen = sum(uni.values()), katz.unseen_mass(tally(uni), low1)
    p1 = lambda w: less(uni[w], low1) / n if w in uni else unseen
    after = collections.defaultdict(dict)
    for (v, w), c in bi.items():
        after[v][w] = c
    count = lambda v: starts if v == b"<s>" else uni[v]

    def p2(v, w):
        if not count(v):
            return p1(w)
        if w in after[v]:
            return less(after[v][w], low2) / count(v)
        left = 1 - sum(less(c, low2) for c in after[v].values()) / count(v)
        return left / (1 - sum(p1(x) for x in after[v])) * p1(w)

    for v in list(after)[:20]:
        assert math.isclose(sum(p2(v, w) for w in [*uni, b"never seen"]), 1)
    out = []
    for w, learn in zip(tokens, train, strict=True):
        base = sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in w)
        score = sum(math.log10(p2(v, x)) for v, x in zip([b"<s>", *w], w, strict=False))
        out.append((not learn, len(w), sum(x in uni for x in w), n, base, score))
    return out


def test_katz_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 300)  # many chunks and shards
    monkeypatch.setattr(katz, "SHARD", 200)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "W1\tw2\x0bw1"), (None, "w1 w2 w3"), (5, rows[5][1]), (203, "ünseen wörds w1")]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS)
    got = [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.katz_scores(docs).collect()]
    want = plain_katz(rows)
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9, atol=1e-9)


def test_katz_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = katz.katz_scores(spark.createDataFrame([(held, "a b", "s", 1, 2)], DOCS)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert katz.katz_scores(spark.createDataFrame([], DOCS)).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(deadline=None)
def test_packed_numbers_come_back(values):
    array = np.array(values, dtype=np.uint64)
    assert katz.unpack(katz.pack(array), len(array)).tolist() == values
    array.sort()
    assert katz.unpack_keys(katz.pack_keys(array), len(array)).tolist() == sorted(values)


@given(st.lists(st.tuples(st.integers(0, 10), st.integers(-1, 3), st.integers(0, 5)), max_size=40))
@settings(deadline=None)
def test_best_fit_takes_the_tightest_compatible_bin(items):
    sizes, sources, clusters = ([x[k] for x in items] for k in range(3))
    bins: list[list[tuple]] = []
    want = []
    for size, source, cluster in items:
        fits = [
            (10 - sum(x[0] for x in b), n)
            for n, b in enumerate(bins)
            if sum(x[0] for x in b) + size <= 10 and all(cluster != x[2] and (source < 0 or source != x[1]) for x in b)
        ]
        n = min(fits)[1] if fits else len(bins)
        if n == len(bins):
            bins.append([])
        bins[n].append((size, source, cluster))
        want.append(n)
    assert best_fit(sizes, sources, clusters, 10) == want


def test_every_word_is_packed_once(spark):
    rng = random.Random(6)
    texts = ["a " * rng.choice([1, 5, 40, 130, 730]) for _ in range(60)] + [None, "", "same words", "SAME  words"]
    rows = [(i, t, rng.choice(["s0", "s0", "s1", "s2", None]), 1, 2) for i, t in enumerate(texts)] + [(None, "x y", "s1", 1, 1)]
    got = pack_documents(spark.createDataFrame(rows, DOCS), capacity=100, shard_bins=8).toPandas()
    assert got.groupby("bin_id")["n_words"].sum().max() <= 100
    sourced = got[got["source"].notna()]
    assert not sourced.duplicated(["bin_id", "source"]).any() and not got.duplicated(["bin_id", "cluster"]).any()
    for i, t in enumerate(texts):
        own = got[got["doc_id"] == i].sort_values("first_word")
        assert own["n_words"].sum() == len((t or "").split())
        assert (own["first_word"] + own["n_words"]).tolist()[:-1] == own["first_word"].tolist()[1:]
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_stay_small_when_texts_are_short(spark):
    rows = [(i, "" if i % 3 else f"w{i}", "hot" if i % 2 else "b", 1, 1) for i in range(600)]
    got = pack_documents(spark.createDataFrame(rows, DOCS), shard_pieces=100).toPandas()
    assert sorted(got["doc_id"]) == list(range(600))
    assert (got["bin_id"] // (1 << 32)).value_counts().between(40, 180).all()
    named = got[got["source"] == "hot"]
    assert not named.duplicated(["bin_id"]).any() and not got.duplicated(["bin_id", "cluster"]).any()


TALKS = "conv_id long, turn long, role string, text string, window int, tokens int"


def test_windows_hold_their_budget_and_every_target_once(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(30):
        for turn in range(rng.choice([1, 2, 9, 40])):
            role = "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            text = rng.choice(["<|im_end|>", "<\\|x", "<\\\\|", "a\nb", ""]) + " w" * rng.choice([0, 3, 30, 90, 400])
            rows.append((conv, turn, role, text, 1, 1))
    rows += [(None, None, None, None, 1, 1), (77, 1, "ro%le\n<", "x", 1, 1), (77, 1, "ro%le\n<", "x", 1, 1), (78, 0, "system", "s", 1, 1)]
    windows = chat_windows(spark.createDataFrame(rows, TALKS)).persist()
    assert windows.where(f"tokens > {BUDGET} and n_new > 1").count() == 0
    assert windows.where("window > 0 and n_repeated > 0").count() > 0
    got = {r.conv_id: r for r in read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [tuple(t) for t in got[conv].turns] == [t[1:] for t in turns]
        assert got[conv].targets == "".join(t for _, role, t in turns if role == "assistant")
    assert chat_windows(spark.createDataFrame([], TALKS)).count() == 0
