"""op2, op5, op9 and the components they rest on."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import passages
from tillroll.llm.embedding_dedup import near_vectors
from tillroll.llm.graph import components
from tillroll.llm.passages import Fenwick, chains, repeated_passages
from tillroll.llm.simhash import drop_near_duplicates, fingerprint_links, near_duplicates

DOCS = "doc_id long, text string, component_id long, fp string, id int"


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(201, 202), (202, 203), (203, 201)]
    links += [(300, 300), (301, 302), (302, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = least_reachable({n for link in links for n in link}, links)
    assert got == {n: c for n, c in want.items() if n != 300}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = 3 if len(found) >= 3 else len(found)
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + n]), 42) for i in range(len(found) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äpfel", "É"]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        texts += [" ".join(base), "\n".join(base), " ".join([*base, "end"]), " ".join(base[:-1])]
    texts += [None, "", "  \t", "one", "ONE", "one two", "a\x0bb\x0cc d"]
    rows = [(i * 3 % 1000, t, 7, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], 7, "x", 1), (None, "lonely text here", 1, "", 0)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = least_reachable(fps, links)
    assert any(want[a] != a and fps[want[a]] != fps[a] for a in fps)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def test_all_links_of_random_fingerprints(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(50)]
    for fp in list(fps):
        for n in range(1, 6):
            fps.append(fp ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    got = {(r.fp, r.other) for r in fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_one_of_each_group_stays(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(5, text, 1, "a", 1), (3, text, 1, "b", 2), (3, text, 1, "b", 2), (9, "another text", 1, "c", 3), (8, None, 1, "", 4), (None, "", 2, "", 5), (None, "no id here", 2, "", 5)]
    got = drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "component_id", "fp", "id"]
    assert sorted(tuple(r) for r in got.collect() if r.doc_id) == [(3, text, 1, "b", 2), (8, None, 1, "", 4), (9, "another text", 1, "c", 3)]
    assert got.where("doc_id is null").count() == 1  # the text that has no other copy


@pytest.mark.parametrize("operator", [near_duplicates, drop_near_duplicates, repeated_passages])
def test_empty_documents(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node long, links int"


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(25):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, 9)):
            v = centre + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.25])
            rows.append((n, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)), 1, 1))
            n += 1
    v = rows[0][1]
    rows += [(n, v, None, 1, 1), (n + 1, None, 0, 1, 1), (n + 2, [0.0] * 24, 0, 1, 1), (n + 3, [float("nan")] * 24, 0, 1, 1)]
    rows += [(n + 4, [None] + v[1:], 0, 1, 1), (n + 5, [float("inf")] * 24, 0, 1, 1), (n + 6, [], 0, 1, 1), (n + 7, v[:5], rows[0][2], 1, 1), (n + 8, v, rows[0][2], 1, 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    clean = {r[0]: (r[2], np.array(r[1])) for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a, (la, va) in clean.items() for b, (lb, vb) in clean.items() if a < b and la == lb and len(va) == len(vb) and cos(va, vb) >= 0.93]
    want = least_reachable([r[0] for r in rows], links)
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    blocks = {r.vec_id: r.n_links for r in near_vectors(frame, block=2).collect()}
    assert blocks == {i: r.n_links for i, r in got.items()}  # blocks change nothing


def test_repeated_vectors_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0], 4, 0, 0), (2, [1.0, 2.0], 4, 0, 0), (2, [1.0, 2.0], 4, 0, 0), (3, [1.0, 2.0], 5, 0, 0), (None, [2.0, -1.0], 4, 0, 0)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_prefix_maxima():
    tree = Fenwick(8)
    for i, v in ((3, 1.0), (5, 4.0), (2, 2.0)):
        tree.put(i, (v, i))
    assert [tree.below(i)[1] for i in (1, 2, 4, 5, 8)] == [-1, 2, 2, 5, 5]


def test_chains_follow_order_and_break_at_gaps():
    x = np.array([0, 10, 20, 200, 210, 15])
    y = np.array([100, 110, 121, 300, 310, 5])
    assert sorted(chains(x, y)) == [(0, 100, 20, 121), (15, 5, 15, 5), (200, 300, 210, 310)]


@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(0, 4), max_size=60))
@settings(max_examples=60, deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert passages._edits(a, b) == row[-1]


@settings(max_examples=80, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from([0, 1, 4, 39, 40, 41, 60, 200, 300]), st.sampled_from([0] * 12 + [1, -3])), min_size=1, max_size=9),
        min_size=1, max_size=4,
    )
)
def test_chains_on_one_diagonal_need_no_search(pairs):
    """Matches of pairs of documents, as steps forward and off the diagonal."""
    matches = [sorted(zip(np.cumsum([s for s, _ in p]).tolist(), np.cumsum([s + off for s, off in p]).tolist())) for p in pairs]
    lows = np.cumsum([0, *map(len, matches[:-1])])
    x, y = (np.array(v) for v in zip(*sum(matches, [])))
    bent, first, last = passages._straight(x, y, lows)
    assert bent.tolist() == [len({b - a for a, b in m}) > 1 for m in matches]
    want = [c for m, b in zip(matches, bent) if not b for c in chains(*map(np.array, zip(*m)))]
    assert sorted(zip(x[first], y[first], x[last], y[last])) == sorted(want)


def test_parts_of_a_text_are_shuffled_together(spark, capsys):
    words = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, words, 1, "", 1), (2, words, 1, "", 1)], DOCS)
    result = repeated_passages(frame)
    result.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(home" in plan and "hashpartitioning(key" not in plan
    assert [(r.doc_id, r.end_word, r.partner_id) for r in result.collect()] == [(2, 60, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60)), min_size=1, max_size=6), st.sampled_from([1, 2, 4]))
def test_ends_of_passages(pairs, price):
    """How far two texts go on together, cell by cell, with the words beyond ``REACH`` left out."""
    ends = [[np.array(s[n], dtype=np.uint32)[: passages.REACH] for s in pairs] for n in (0, 1)]
    flat = [np.concatenate([*e, np.zeros(1, np.uint32)]) for e in ends]
    sizes = [np.array([len(v) for v in e]) for e in ends]
    base = [np.cumsum([0, *n[:-1]]) for n in sizes]
    one = passages._words_from(flat[0], base[0], sizes[0], 1, passages.REACH, 0, passages.NONE)
    two = passages._words_from(flat[1], base[1], sizes[1], 1, passages.REACH + 2 * passages.DRIFT, passages.DRIFT, passages.NONE - 1)
    got = list(zip(*(v.tolist() for v in passages._beyond(one, two, price))))
    for (a, b), (end_a, end_b) in zip(zip(*ends), got):
        best, at = 0, (0, 0)
        last = {j: -price * j for j in range(passages.DRIFT + 1)}
        for i in range(1, passages.REACH + 1):
            row = {}
            for j in range(i - passages.DRIFT, i + passages.DRIFT + 1):
                same = i <= len(a) and 1 <= j <= len(b) and a[i - 1] == b[j - 1]
                ways = [last[j - 1] + (1 if same else -price)] if j - 1 in last else []
                ways += [last[j] - price] if j in last else []
                ways += [row[j - 1] - price] if j - 1 in row else []
                if ways:
                    row[j] = max(ways)
            top = max(row.values())
            places = [j for j, v in row.items() if v == top]
            if top > best or price == 1 and top == best:
                best, at = top, (i, places[-1] if price == 1 else places[0])
            last = row
        assert (end_a, end_b) == at


def test_one_passage_in_every_document(spark, monkeypatch):
    """Seeds and texts with a large share of all rows, in lots of a few."""
    monkeypatch.setattr(passages, "LOT", 4)
    rng = random.Random(5)
    shared = [f"{rng.randrange(10**9)}" for _ in range(70)]
    rows = [
        (i, " ".join([*(f"{rng.randrange(10**9)}" for _ in range(i % 50)), *shared]), 1, "", 1) for i in range(120)
    ]
    for hot in (2, 10**9):  # few hot ones, and nothing that is not
        monkeypatch.setattr(passages, "HOT", hot)
        got = sorted((r.doc_id, r.first_word, r.end_word, r.partner_id) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect())
        assert got == [(i, i % 50, i % 50 + 70, 0) for i in range(1, 120)]


def test_passages_are_found_with_their_places(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    shared, short, fuzzy = fresh(80), fresh(30), fresh(100)
    edited = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(fuzzy)]
    docs = {
        2: fresh(200) + shared + fresh(50), 4: fresh(7) + shared, 7: shared + fresh(300), 9: fresh(90) + short,
        11: short + fresh(90), 13: fresh(20) + fuzzy + fresh(20), 15: fresh(400) + edited, 17: [], 18: fresh(3000),
    }
    rows = [(i, " ".join(w).upper(), 1, "", 1) for i, w in docs.items()] + [(None, " ".join(shared), 1, "", 1), (20, None, 1, "", 1)]
    rows.append((4, " ".join(docs[4]).upper(), 1, "", 1))  # a repeated row
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {4, 7, 15}
    assert (got[4].first_word, got[4].end_word, got[4].partner_id, got[4].partner_first, got[4].similarity) == (7, 87, 2, 200, 1.0)
    assert (got[7].first_word, got[7].end_word, got[7].partner_first, got[7].partner_end) == (0, 80, 200, 280)
    assert got[15].partner_id == 13 and got[15].end_word - got[15].first_word >= 90 and 0.9 < got[15].similarity < 1


def test_long_copies_that_drift(spark):
    """Ten insertions early and ten deletions late: the middle is shifted by a hundred words."""
    rng = random.Random(11)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    text, other = fresh(2000), []
    for i, w in enumerate(text):
        if i < 500 and i % 50 == 20:
            other += fresh(10)
        if i < 1500 or not 20 <= i % 50 < 30:
            other.append(w)
    rows = [(1, " ".join(text), 1, "", 1), (2, " ".join(other), 1, "", 1)]
    (got,) = repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert (got.first_word, got.end_word, got.partner_first, got.partner_end) == (0, 2000, 0, 2000)
    assert got.similarity >= 0.9


def test_edited_passages_near_the_least_length(spark):
    """Substitutions, insertions and deletions in passages of 55 to 80 words between unrelated ones."""
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    rows, cells = [], {}
    for size, share in [(60, 0.05), (60, 0.1), (80, 0.1)]:
        for _ in range(100):
            shared, edited = fresh(size), []
            for w in shared:
                kind = rng.randrange(3) if rng.random() < share else 3
                edited += [fresh(1), [w, *fresh(1)], [], [w]][kind]
            n = len(rows)
            rows += [(n + k, " ".join([*fresh(60), *w, *fresh(60)]), 1, "", 1) for k, w in enumerate((shared, edited))]
            cells[n + 1] = (size, share)
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    lost = {cell: sum(c == cell and n not in found for n, c in cells.items()) for cell in set(cells.values())}
    print(lost)
    assert lost[60, 0.05] <= 2 and lost[60, 0.1] <= 8 and lost[80, 0.1] <= 2


def test_passages_of_common_lines(spark):
    """Verbatim passages whose lines, and most pairs of lines, stand earlier in other texts."""
    rng = random.Random(13)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(20) for _ in range(12)]
    texts = [[*fresh(9), *line, *fresh(9)] for line in lines]
    texts += [[*fresh(9), *a, *b, *fresh(9)] for a in lines for b in lines if a is not b]
    firsts = len(texts)
    for _ in range(60):
        shared = sum(rng.sample(lines, 3), [])
        texts += [[*fresh(40), *shared, *fresh(40)], [*fresh(30), *shared]]
    size = passages.LEAST + passages.SPAN - 1
    runs: dict[tuple, set[int]] = {}
    for n, text in enumerate(texts):
        for i in range(len(text) - size + 1):
            runs.setdefault(tuple(text[i : i + size]), set()).add(n)
    links = {(min(r), n) for r in runs.values() for n in r if n != min(r)}
    assert len(links) >= 60 and min(links)[0] >= firsts
    rows = [(n, " ".join(text), 1, "", 1) for n, text in enumerate(texts)]
    got = {(r.partner_id, r.doc_id) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert links <= got
    assert got <= {(a, b) for a, b in got if len(set(texts[a]) & set(texts[b])) >= 40}


def test_every_pair_of_edited_passages_of_common_lines(spark, monkeypatch):
    """Lines, and pairs of them, stand earlier in other texts; pairs of texts share three, with an edit in each."""
    rng = random.Random(14)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(18) for _ in range(10)]
    texts = [[*fresh(9), *line, *fresh(9)] for line in lines]
    texts += [[*fresh(60), *a, *b, *fresh(60)] for a in lines for b in lines if a is not b]
    links = set()
    for _ in range(25):
        shared = sum(rng.sample(lines, 3), [])
        edited = [fresh(1)[0] if i % 18 == 9 else w for i, w in enumerate(shared)]
        links.add((len(texts), len(texts) + 1))
        texts += [[*fresh(60), *shared, *fresh(60)], [*fresh(60), *edited, *fresh(60)]]
    rows = [(n, " ".join(text), 1, "", 1) for n, text in enumerate(texts)]
    rows += [(n + 1000, *rows[n][1:]) for n in range(len(texts) - 6, len(texts))]  # copies
    frame = spark.createDataFrame(rows, DOCS)
    found = lambda **kw: sorted((r.partner_id, r.doc_id, r.first_word, r.end_word) for r in repeated_passages(frame, **kw).collect())
    got = found(every=True)
    pairs = {g[:2] for g in got}
    assert links <= pairs and not links <= {g[:2] for g in found()}
    assert {(a, b) for a, b in pairs if b >= 1000} == {(n, n + 1000) for n in range(len(texts) - 6, len(texts))}
    alone = set()  # each two texts by themselves
    for a, b in sorted(links)[:2]:
        two = repeated_passages(spark.createDataFrame([rows[a], rows[b]], DOCS)).collect()
        alone |= {(r.partner_id, r.doc_id, r.first_word, r.end_word) for r in two}
    assert len(alone) >= 2 and alone <= set(got)
    monkeypatch.setattr(passages, "CELL", 3)  # many lots of a seed
    assert found(every=True) == got


def plain_matches(texts):
    """Every two occurrences of a seed in different texts, one by one; runs of repeated words from both ends."""
    first, places, out = {}, {}, set()
    for node in sorted(texts):
        seeds, _, at, _, _ = passages._seed_places(pa.array([texts[node]]))
        places[node] = sorted(zip(seeds.tolist(), at.tolist()))
        if texts[node] in first:
            out |= {(node, first[texts[node]], place, place) for _, place in places.pop(node)}
        first.setdefault(texts[node], node)
    found = {}
    for node, own in places.items():
        if len(texts[node].split()) < passages.LEAST:
            continue
        runs = []
        for seed, place in own:
            if not runs or runs[-1][-1][0] != seed or place - runs[-1][-1][1] >= passages.K:
                runs.append([])
            runs[-1].append((seed, place))
        for run in runs:
            long = run[-1][1] - run[0][1] >= passages.TURNS
            for n, (seed, place) in enumerate(run):
                turns = (n, len(run) - 1 - n) if long else (0, 0)
                found.setdefault(seed, []).append((node, place, *turns))
    for rows in found.values():
        for one in rows:
            for two in rows:
                if one[0] < two[0] and (one[2] == two[2] or one[3] == two[3]):
                    out.add((two[0], one[0], two[1], one[1]))
    return out


@pytest.mark.parametrize("changed", [{}, {"CELL": 3, "PAIRS": 5}, {"CELL": 3, "FEW": 20}, {"FEW": 20}])
def test_every_two_occurrences_of_a_seed_meet(spark, monkeypatch, changed):
    rng = random.Random(31)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(12) for _ in range(4)] + [["of"] * n for n in (30, 110, 170)] + [["a", "b"] * 60]
    texts = [" ".join(sum([fresh(9), *rng.sample(lines, 2), fresh(9), rng.choice(lines)], [])) for _ in range(25)]
    texts += texts[3:6] + [" ".join(lines[0]), " ".join(fresh(20) + lines[1]), "", " ".join(fresh(50))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for name, value in changed.items():
        monkeypatch.setattr(passages, name, value)
    pairs = lambda df: {(r.id, r.partner, r["at"], r.partner_at) for r in df.collect()}
    want = plain_matches(dict(enumerate(texts)))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(batch)
    spark.conf.set(batch, "17")
    try:
        assert pairs(passages._all_matches(frame)) == want | pairs(passages._matches(frame)) and len(want) > 1000
    finally:
        spark.conf.set(batch, kept)


def test_turns_of_frequent_seeds_are_dealt_out():
    """No turn of the first seed has more than ``CELL`` rows, but the seed has."""
    texts, turns = 64, 40
    assert texts < passages.CELL < texts * turns
    rows = [(7, 0, 0, n, 5 * h, h << 32 | turns - 1 - h) for n in range(texts) for h in range(turns)]
    rows += [(8, 0, 0, n, 900, 0) for n in range(3)]
    seed, short, long, ids, at, turn = (np.array(c) for c in zip(*rows))
    table = lambda *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=list("abcdef")[: len(c)])
    dealt = [r for b in passages._dealt([table(seed, short, ids, at, turn)]) for r in b.to_pylist()]
    assert len(dealt) == 2 * texts * turns and {(r["seed"], r["lots"]) for r in dealt} == {(7, 1)}
    met = [r for b in passages._to_each([table(seed, ids, at, short - 1, long - 1, turn)]) for r in b.to_pylist()]
    assert len([r for r in met if r["at"] < 900]) == (texts - 1) * turns  # with the first only
    assert {(r["id"], r["partner"]) for r in met if r["at"] == 900} == {(1, 0), (2, 0), (2, 1)}


def test_all_pairs_shuffle_the_seeds_once(spark, capsys):
    words = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, words), (2, f"{words} x")], "id long, text string")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no reuse before it runs
    try:
        passages._all_matches(frame).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    plan = capsys.readouterr().out.splitlines()
    assert len([x for x in plan if "hashpartitioning(seed" in x and "ReusedExchange" not in x]) == 1


def staged_by(monkeypatch):
    """The tables that op9 stages from now on, by label."""
    seen, before = {}, passages.stage

    def stage(df, label):
        seen[label] = before(df, label)
        return seen[label]

    monkeypatch.setattr(passages, "stage", stage)
    return seen


def test_a_part_of_a_text_goes_to_a_cell_once(spark, monkeypatch):
    """However many chains want it; before, each chain had the words of both sides for itself."""
    rng = random.Random(41)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(60)
    rows = [(n, " ".join([*fresh(60), *shared, *fresh(60)]), 1, "", 1) for n in range(30)]
    frame, seen = spark.createDataFrame(rows, DOCS), staged_by(monkeypatch)
    got = sorted(repeated_passages(frame, every=True).collect())
    assert len(got) == 30 * 29 // 2 and all(r.end_word - r.first_word == 60 for r in got)
    parts = seen["wanted"].collect()
    assert len(parts) == len(set(parts)) == 30 and seen["chains"].count() == len(got)
    monkeypatch.setattr(passages, "CHAINS", 40)
    assert sorted(repeated_passages(frame, every=True).collect()) == got
    cells = {r.home for r in seen["wanted"].collect()}
    assert len(cells) > 6 and seen["wanted"].count() <= 30 * (2 * 4)  # a row and a column of cells each


def test_later_copies_are_matched_once(spark, monkeypatch):
    """All later copies of a text have the passages of the second one; before, each was matched by itself."""
    rng = random.Random(42)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(60)
    texts = [fresh(20) + shared, fresh(9) + shared + fresh(70), fresh(30), shared + shared]
    rows = [(n, " ".join(w), 1, "", 1) for n, w in enumerate(texts)]
    seen = staged_by(monkeypatch)

    def found(copies):
        more = [(100 * k + n, rows[n][1], 1, "", 1) for k in range(1, 1 + copies) for n in (1, 2, 3)]
        got = repeated_passages(spark.createDataFrame(rows + more, DOCS), every=True).collect()
        return sorted(tuple(r) for r in got), seen["chains"].count()

    (once, few), (often, many) = found(1), found(12)
    assert few == many
    assert [r for r in often if r[0] < 200] == once and any(r[0] == 101 and r[3] == 0 for r in once)
    for k in range(2, 13):
        assert [(r[0] % 100, *r[1:]) for r in often if r[0] // 100 == k] == [(r[0] - 100, *r[1:]) for r in once if r[0] >= 100]
    monkeypatch.setattr(passages, "SMALL", 0)
    assert found(12)[0] == often


def test_numbers_of_runs():
    ids = np.random.default_rng(1).integers(0, 3, 200).astype(np.uint64)
    for size in (1, 3, 16, 50, 200, 201):
        got = passages._runs(ids, size)
        known = [tuple(ids[i : i + size].tolist()) for i in range(200 - size + 1)]
        assert len(set(zip(known, got.tolist()))) == len(set(known)) == len(set(got[: len(known)].tolist()))
        assert not got[len(known) :].any()


def test_texts_that_share_an_id_or_have_none(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    shared, other = fresh(60), fresh(60)
    texts = [(1, fresh(20) + shared), (1, fresh(30)), (2, shared + fresh(9)), (3, other), (None, other), (None, shared), (3, other)]
    rows = [(i, " ".join(w), 1, "", 1) for i, w in texts]
    found = lambda **kw: sorted(
        ((r.doc_id, r.partner_id, r.end_word - r.first_word) for r in repeated_passages(spark.createDataFrame(rows, DOCS), **kw).collect()),
        key=str,
    )
    # Whichever text of id 1 has the smaller hash, the passage of 1 and 2 is found.
    (link,) = found()
    assert link[2] == 60 and set(link[:2]) == {1, 2}
    links = found(null_ids=True)
    assert len(links) == 3 and all(n == 60 for *_, n in links)
    assert (None, 3, 60) in links and {1, 2} in [set(link[:2]) for link in links]
    assert sum(link[0] is None and link[1] in (1, 2) for link in links) == 1


def test_hot_seeds_are_matched_like_others(spark, monkeypatch):
    rng = random.Random(22)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(25) for _ in range(6)]
    rows = [(i, " ".join(sum([fresh(5), *rng.sample(lines, 3), fresh(i % 7)], [])), 1, "", 1) for i in range(80)]
    frame = spark.createDataFrame(rows, DOCS)
    assert len(passages._hot_seeds(frame.selectExpr("doc_id as id", "text"))) == 0
    cold = sorted(repeated_passages(frame).collect())
    monkeypatch.setattr(passages, "FEW", 20)
    assert len(passages._hot_seeds(frame.selectExpr("doc_id as id", "text"))) > 20
    assert sorted(repeated_passages(frame).collect()) == cold and len(cold) > 60


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 5), st.integers(-1, 1), st.integers(-1, 1)), max_size=40),
    st.integers(1, 9),
)
def test_first_occurrences_across_batches(rows, size):
    rows = sorted({r[:3]: r for r in rows}.values())
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(zip(*rows[b : b + size]))], names=list("abcde"))
        for b in range(0, len(rows), size)
    ]
    got = sorted(tuple(r.values()) for b in passages._to_first(iter(batches)) for r in b.to_pylist())
    want = set()
    for seed, node, at, *wide in rows:
        for k in (None, 0, 1):
            if k is None or wide[k] >= 0:
                first = min(r[1:3] for r in rows if r[0] == seed and (k is None or r[3 + k] == wide[k]))
                if first[0] != node:
                    want.add((node, first[0], at, first[1]))
    assert set(got) == want


def test_runs_that_are_not_there_take_no_match_away():
    rows = [(1, 0, 0, 0, 1), (1, 0, 1, -1, 0), (1, 1, 0, -1, 0)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(row)], names=list("abcde"))
        for row in rows
    ]
    got = {tuple(r.values()) for b in passages._to_first(iter(batches)) for r in b.to_pylist()}
    assert got == {(1, 0, 0, 0), (1, 0, 0, 1)}
