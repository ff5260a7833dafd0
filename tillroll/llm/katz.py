"""A word bigram model with Katz backoff, and the scores it gives to documents.

Counts are Good-Turing discounted; what a context loses is given to the words not seen after
it, in proportion to their unigram probabilities, with a weight that makes the probabilities
after every context sum to one. Unigrams hand what they lose to the unseen word.

Documents are read once, into chunks of some million tokens: word ids, and per token a number
in the chunk's own word list. A chunk asks for each of its different unigrams and bigrams once;
ids are dealt to shards by hash, the question carries the chunk's training count, and a
shard's answer is the total, in the order of the question. So one hot word is one entry per
chunk, no matter how often it occurs. Shards grow in number with the tokens. Counts are
written as tables partitioned by kind, and every later step reads what was written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import group_sums, mix, pieces, words
from tillroll.staging import stage, staging_path

CHUNK = 1_500_000  # tokens
SHARD = 2_000_000  # tokens of the corpus for each shard of bigrams
DISCOUNTED = 5  # counts up to this are discounted by Good and Turing
TAIL = 0.1  # larger counts lose this much, so that no context is left without mass

_START = np.uint64(0xA0761D6478BD642F)
_END = np.uint64(0xE7037ED1A0B428DB)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, without the planes that are zero everywhere."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = values.view(np.uint8).reshape(-1, 8).T
    top = int(values.max(initial=0))
    return np.ascontiguousarray(planes[: max(1, (top.bit_length() + 7) // 8)]).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    out = np.zeros(n, dtype=np.uint64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.uint64) << np.uint64(8 * k)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and for each value its place among them."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[codes]


def _shard_cuts(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order lie in shards in order: the shards in use and where each begins."""
    shard = ((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)
    used, first = np.unique(shard.astype(np.int64), return_index=True)
    return used, np.append(first, len(keys))


def _in_training(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds != fold


class Chunk:
    """Tokens of some documents as numbers into a list of word ids; each document ends in an end token."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, counts: np.ndarray, train: np.ndarray):
        self.vocabulary, self.codes, self.counts, self.train = vocabulary, codes, counts, train
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.by_id = np.argsort(vocabulary)
        before = np.empty(len(codes), dtype=np.int64)
        before[1:] = codes[:-1] + 1
        before[self.first[:-1]] = 0  # the start of a document
        self.pairs, self.pair_of = _ranked(before * len(vocabulary) + codes)
        self.before, self.after = np.divmod(self.pairs, len(vocabulary))
        ids = np.concatenate([[_START], vocabulary])
        self.keys = mix(mix(ids)[self.before] * _PAIR + vocabulary[self.after])
        self.by_key = np.argsort(self.keys)

    def training_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word and each pair."""
        weight = np.repeat(self.train, self.counts).astype(np.float64)
        words_ = np.bincount(self.codes, weights=weight, minlength=len(self.vocabulary))
        return words_.astype(np.uint64), np.bincount(self.pair_of, weights=weight).astype(np.uint64)


def _chunks(folds: int, fold: int, size: int):
    names = ["chunk", "ids", "training", "counts", "train", "vocabulary", "codes"]

    def scan(batches):
        number = TaskContext.get().partitionId() << 24
        tokens, ids, counts, held = [], [], [], 0

        def row():
            stream = np.concatenate(tokens)
            codes, found = pd.factorize(stream)
            order = np.argsort(-np.bincount(codes), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            train = np.array([_in_training(i, folds, fold) for i in ids], dtype=np.uint8)
            columns = [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([int(train.sum())], pa.int64()),
                pa.array([pack(np.concatenate(counts))], pa.binary()),
                pa.array([train.tobytes()], pa.binary()),
                pa.array([found[order].tobytes()], pa.binary()),
                pa.array([zlib.compress(pack(rank[codes]), 1)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in pieces(batches, most=2 << 20):
            found = words(part.column("text"))
            n = found.counts + 1
            ends = np.cumsum(n) - 1
            stream = np.empty(int(n.sum()), dtype=np.uint64)
            is_end = np.zeros(len(stream), dtype=bool)
            is_end[ends] = True
            stream[is_end], stream[~is_end] = _END, found.hashes()
            tokens.append(stream)
            counts.append(n)
            ids += part.column("id").to_pylist()
            held += len(stream)
            if held >= size:
                yield row()
                number += 1
                tokens, ids, counts, held = [], [], [], 0
        if ids:
            yield row()

    return scan


def _load(row) -> Chunk:
    n = len(row["train"])
    counts = unpack(row["counts"], n).astype(np.int64)
    codes = unpack(zlib.decompress(row["codes"]), int(counts.sum())).astype(np.int64)
    return Chunk(np.frombuffer(row["vocabulary"], np.uint64), codes, counts, np.frombuffer(row["train"], np.uint8))


def _questions(shards: dict[int, int]):
    """Per chunk, order and shard: the keys wanted and how often training documents hold them here."""
    names = ["gram", "shard", "chunk", "n", "keys", "counts"]

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _load(row)
                unigrams, bigrams = chunk.training_counts()
                for gram, keys, counts in (
                    (1, chunk.vocabulary[chunk.by_id], unigrams[chunk.by_id]),
                    (2, chunk.keys[chunk.by_key], bigrams[chunk.by_key]),
                ):
                    used, first = _shard_cuts(keys, shards[gram])
                    spans = [slice(a, b) for a, b in zip(first, first[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([gram] * len(used), pa.int32()),
                            pa.array(used),
                            pa.array([row["chunk"]] * len(used), pa.int64()),
                            pa.array([s.stop - s.start for s in spans], pa.int64()),
                            pa.array([pack_keys(keys[s]) for s in spans], pa.binary()),
                            pa.array([pack(counts[s]) for s in spans], pa.binary()),
                        ],
                        names=names,
                    )

    return scan


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """One shard: its part of the count table, and an answer for each chunk that asked."""
    group = group.sort_values("chunk")
    sizes = group["n"].tolist()
    keys = np.concatenate([unpack_keys(k, n) for k, n in zip(group["keys"], sizes, strict=True)])
    counts = np.concatenate([unpack(c, n) for c, n in zip(group["counts"], sizes, strict=True)])
    found, place = _ranked(keys)
    total = np.bincount(place, weights=counts.astype(np.float64)).astype(np.uint64)
    # The first chunk that asks for a key speaks for it later on, so it is summed once.
    first = np.full(len(found), len(keys))
    np.minimum.at(first, place, np.arange(len(keys)))
    answer = total[place] << np.uint64(1)
    answer[first] |= np.uint64(1)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    seen = total > 0
    tally = [int(seen.sum()), int(total.sum()), *((total == r).sum() for r in range(1, DISCOUNTED + 2))]
    gram, shard = group["gram"].iloc[0], group["shard"].iloc[0]
    table = {
        "kind": "counts", "gram": gram, "shard": shard, "chunk": -1, "n": int(seen.sum()),
        "keys": pack_keys(found[seen]), "payload": pack(total[seen]), "tally": [int(x) for x in tally],
    }
    answers = [
        {
            "kind": "answers", "gram": gram, "shard": shard, "chunk": chunk, "n": b - a,
            "keys": None, "payload": pack(answer[a:b]), "tally": None,
        }
        for chunk, a, b in zip(group["chunk"], cuts, cuts[1:], strict=False)
    ]
    return pd.DataFrame([table, *answers])


def discounted(tally: list[int]) -> np.ndarray:
    """Discounted counts 0 to ``DISCOUNTED`` from [different, tokens, n1, n2, ...].

    Good and Turing's estimate as Katz scales it, for the counts up to the largest k for which
    it lies between zero and the count; with no such k, half a count less.
    """
    n = [0, *tally[2:]]
    for k in range(DISCOUNTED, 0, -1):
        if min(n[1 : k + 2]) <= 0 or (k + 1) * n[k + 1] >= n[1]:
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        ratio = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in ratio):
            low = [r * d for r, d in enumerate(ratio, 1)]
            return np.array([0.0, *low, *(r - TAIL for r in range(k + 1, DISCOUNTED + 1))])
    return np.array([0.0, *(r - 0.5 for r in range(1, DISCOUNTED + 1))])


def discount(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float64)
    return np.where(counts <= DISCOUNTED, low[np.minimum(counts, DISCOUNTED).astype(np.int64)], counts - TAIL)


def _evaluate(uni: list[int], low: dict[int, np.ndarray], training_docs: int, shards: int):
    """One chunk: what it knows of its documents' scores, and what it asks or says of contexts."""
    kinds, tokens = uni[0], uni[1]
    names = ["shard", "chunk", "docs", "n", "keys", "loss", "mass", "asked", "asked_keys", "asked_docs", "asked_n"]

    def probability(counts: np.ndarray, unseen: float) -> np.ndarray:
        return np.where(counts > 0, discount(counts, low[1]) / max(tokens, 1), unseen)

    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        chunk = _load(row)
        answers = {}
        for gram, order in ((1, chunk.by_id), (2, chunk.by_key)):
            own = right[right["gram"] == gram].sort_values("shard")
            got = np.concatenate([unpack(p, n) for p, n in zip(own["payload"], own["n"], strict=True)])
            answers[gram] = np.empty(len(got), dtype=np.uint64)
            answers[gram][order] = got
        count = (answers[1] >> np.uint64(1)).astype(np.int64)
        pair_count = (answers[2] >> np.uint64(1)).astype(np.int64)
        speaks = (answers[2] & np.uint64(1)).astype(bool) & (pair_count > 0)
        unseen = unseen_mass(uni, low[1])
        p1 = probability(count, unseen)
        context = np.concatenate([[training_docs], count])[chunk.before]
        seen = pair_count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(
                seen,
                np.log10(discount(pair_count, low[2]) / np.maximum(context, 1)),
                np.log10(p1[chunk.after]) - np.log10(np.maximum(context, 1)),
            )
        open_ = ~seen & (context > 0)  # backs off from a known context: its weight is still to come
        base = np.log10((count + 1) / (tokens + kinds + 1))
        token_known = count[chunk.codes] > 0
        documents = pd.DataFrame(
            {
                "id": pd.array([None if i is None or i != i else int(i) for i in row["ids"]], dtype="Int64"),
                "tokens": chunk.counts,
                "known": group_sums(token_known, chunk.first),
                "base": group_sums(base[chunk.codes], chunk.first),
                "score": group_sums(logs[chunk.pair_of], chunk.first),
                "train": chunk.train,
            }
        )
        # What the pairs this chunk speaks for take from their contexts.
        spoken = np.flatnonzero(speaks)
        who, at = _ranked(chunk.before[spoken]) if len(spoken) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        loss = np.bincount(at, weights=pair_count[spoken] - discount(pair_count[spoken], low[2]), minlength=len(who))
        mass = np.bincount(at, weights=p1[chunk.after[spoken]], minlength=len(who))
        ids = mix(np.concatenate([[_START], chunk.vocabulary]))
        keys = ids[who]
        order = np.argsort(keys)
        keys, loss, mass = keys[order], loss[order], mass[order]
        # Which weights its documents want, and how often.
        wanted = np.flatnonzero(open_[chunk.pair_of])
        doc_of = np.repeat(np.arange(len(chunk.counts)), chunk.counts)[wanted]
        ask = chunk.before[chunk.pair_of[wanted]]
        both, n = np.unique(doc_of * (len(ids) + 1) + ask, return_counts=True)
        ask_doc, ask = np.divmod(both, len(ids) + 1)
        ask_key = ids[ask]
        by_key = np.lexsort((ask_doc, ask_key))
        ask_key, ask_doc, n = ask_key[by_key], ask_doc[by_key], n[by_key]
        cut = {s: slice(a, b) for s, a, b in _spans(keys, shards)}
        asked = {s: slice(a, b) for s, a, b in _spans(ask_key, shards)}
        none = slice(0, 0)
        rows = [(int(row["chunk"]) % shards, documents.to_dict("list"))]
        out = [
            (s, row["chunk"], None, len(keys[c]), pack_keys(keys[c]), zlib.compress(loss[c].tobytes(), 1),
             zlib.compress(mass[c].tobytes(), 1), len(ask_key[a]), pack_keys(ask_key[a]), pack(ask_doc[a]), pack(n[a]))
            for s in sorted({*cut, *asked})
            for c, a in [(cut.get(s, none), asked.get(s, none))]
        ]
        out += [(s, row["chunk"], _documents(d), 0, b"", b"", b"", 0, b"", b"", b"") for s, d in rows]
        return pd.DataFrame(out, columns=names)

    return work


def _documents(columns: dict) -> list[dict]:
    names = list(columns)
    return [
        {k: (None if v is pd.NA else v) for k, v in zip(names, values, strict=True)}
        for values in zip(*columns.values(), strict=True)
    ]


def _spans(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    used, first = _shard_cuts(keys, shards)
    return [(int(s), int(a), int(b)) for s, a, b in zip(used, first, first[1:], strict=False)]


def unseen_mass(uni: list[int], low: np.ndarray) -> float:
    """What the unigrams hand to the unseen word: all that their counts lose."""
    if not uni[1]:
        return 1.0
    lost = sum(n * (r - low[r]) for r, n in enumerate(uni[2 : 2 + DISCOUNTED], 1))
    more = uni[0] - sum(uni[2 : 2 + DISCOUNTED])
    return (lost + more * TAIL) / uni[1]


def _weigh(group: pd.DataFrame) -> pd.DataFrame:
    """One shard of contexts: the backoff weights, for the documents that want them."""
    out = []
    keys, loss, mass = [], [], []
    for r in group.itertuples(index=False):
        keys.append(unpack_keys(r.keys, r.n))
        if r.n:
            loss.append(np.frombuffer(zlib.decompress(r.loss)))
            mass.append(np.frombuffer(zlib.decompress(r.mass)))
    contexts, place = _ranked(np.concatenate(keys))
    # Weight, but for the context's count: what it lost over what its unseen words have as unigrams.
    lost = np.bincount(place, weights=np.concatenate([*loss, np.zeros(0)]), minlength=len(contexts))
    taken = np.bincount(place, weights=np.concatenate([*mass, np.zeros(0)]), minlength=len(contexts))
    logs = np.log10(lost) - np.log10(np.maximum(1 - taken, 1e-300))
    for r in group.itertuples(index=False):
        docs, sums = b"", b""
        if r.asked:
            at = np.searchsorted(contexts, unpack_keys(r.asked_keys, r.asked))
            doc = unpack(r.asked_docs, r.asked).astype(np.int64)
            times = unpack(r.asked_n, r.asked).astype(np.float64)
            who, at_doc = np.unique(doc, return_inverse=True)
            docs = who.astype(np.int32).tobytes()
            sums = np.bincount(at_doc, weights=logs[at] * times).tobytes()
        out.append((r.chunk, r.docs, docs, sums))
    return pd.DataFrame(out, columns=["chunk", "docs", "who", "sums"])


def _finish(group: pd.DataFrame) -> pd.DataFrame:
    """One chunk: its documents, with the weights of all shards added to what it knew."""
    known = next(d for d in group["docs"] if d is not None)
    out = pd.DataFrame(list(known), columns=["id", "tokens", "known", "base", "score", "train"])
    more = np.zeros(len(out))
    for who, sums in sorted(zip(group["who"], group["sums"], strict=True)):
        more[np.frombuffer(who, np.int32)] += np.frombuffer(sums)
    return out.assign(id=out["id"].astype("Int64"), score=out["score"] + more)


def katz_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``.

    The model learns from all documents whose crc32(id as text) does not leave ``fold`` by
    ``folds``; a null id counts as a training document. Null texts are empty: one end token.
    Repeated rows count as often as they come. Without any training document every word is
    unseen and has probability one. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "chunk long, ids array<long>, training long, counts binary, train binary, vocabulary binary, codes binary"
    chunks = stage(texts.mapInArrow(_chunks(folds, fold, CHUNK), schema), "chunks")
    sizes = chunks.select(
        "training", F.length("vocabulary").alias("bytes")
    ).agg(F.sum("training"), F.sum("bytes"), F.count(F.lit(1)))
    training_docs, listed, written_chunks = sizes.first()
    training_docs, listed = training_docs or 0, (listed or 0) // 8
    # Lists hold about a tenth of the tokens or more; shards follow them.
    shards = {1: max(1, listed // (SHARD // 2)), 2: max(1, 8 * listed // SHARD)}

    questions = chunks.mapInArrow(
        _questions(shards), "gram int, shard long, chunk long, n long, keys binary, counts binary"
    )
    # As many tasks as shards and chunks ask for, so that a task's part doesn't grow with the table.
    by_chunk = max(1, 2 * written_chunks), "chunk"
    dealt = questions.repartition(2 * sum(shards.values()), "gram", "shard")
    counted = dealt.groupBy("gram", "shard").applyInPandas(
        _count,
        "kind string, gram int, shard long, chunk long, n long, keys binary, payload binary, tally array<long>",
    )
    path = staging_path(docs.sparkSession, "ngrams")
    counted.write.partitionBy("kind", "gram").parquet(path)
    read = "shard long, chunk long, n long, keys binary, payload binary, tally array<long>, kind string, gram int"
    written = docs.sparkSession.read.schema(read).parquet(path)

    tallies = {
        r["gram"]: list(r)[1:]
        for r in written.where("kind = 'counts'")
        .groupBy("gram")
        .agg(*[F.sum(F.get("tally", F.lit(i))).alias(f"t{i}") for i in range(DISCOUNTED + 3)])
        .collect()
    }
    none = [0] * (DISCOUNTED + 3)
    uni = tallies.get(1, none)
    low = {gram: discounted(tallies.get(gram, none)) for gram in (1, 2)}

    answers = written.where("kind = 'answers'").select("gram", "shard", "chunk", "n", "payload")
    documents = "array<struct<id: long, tokens: long, known: long, base: double, score: double, train: int>>"
    said = (
        chunks.repartition(*by_chunk).groupBy("chunk")
        .cogroup(answers.repartition(*by_chunk).groupBy("chunk"))
        .applyInPandas(
            _evaluate(uni, low, training_docs, shards[2]),
            f"shard long, chunk long, docs {documents}, n long, keys binary, loss binary, mass binary, "
            "asked long, asked_keys binary, asked_docs binary, asked_n binary",
        )
    )
    weighed = said.repartition(2 * shards[2], "shard").groupBy("shard").applyInPandas(
        _weigh, f"chunk long, docs {documents}, who binary, sums binary"
    )
    return (
        weighed.repartition(*by_chunk).groupBy("chunk")
        .applyInPandas(_finish, "id long, tokens long, known long, base double, score double, train int")
        .select(
            F.col("id").alias(id_col),
            (F.col("train") == 0).alias("held_out"),
            F.col("tokens").alias("n_tokens"),
            F.col("known").alias("n_known"),
            F.lit(uni[1]).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"),
            "score",
        )
    )
