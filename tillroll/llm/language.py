"""Languages of documents as mixtures.

Every letter gives an n-gram of itself and its two neighbours (bytes, other characters than
letters count as one gap), filed under one of ``BUCKETS`` numbers. Training counts the
n-grams of each language. A word's likelihood in a language is the product over its
n-grams; a document is a mixture of languages whose proportions expectation-maximisation
estimates from the words' likelihoods. The language set is the one with the best
likelihood less ``PENALTY`` * log(1 + words) for each language after the first, among the
sets of the 1, 2, ... languages with the largest proportions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import group_sums, mix, pieces, text_bytes

BUCKETS = 1 << 16
PENALTY = 4.0
ROUNDS = 10
LANGUAGES = 500  # the table of likelihoods has BUCKETS numbers for each

_CLASS = np.zeros(256, dtype=np.int64)  # 0 is the gap between words
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_GRAM = (mix(np.arange(155**2)) % np.uint64(BUCKETS)).astype(np.int64)
_NEXT = (mix(np.arange(155) + 155**2) % np.uint64(BUCKETS)).astype(np.int64)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram numbers, where each word begins among them, and where each text begins among the words.

    Texts end in a gap (see ``_texts``), so no n-gram spans two of them.
    """
    raw, bounds = text_bytes(column)
    codes = np.zeros(len(raw) + 2, dtype=np.int64)
    codes[1:-1] = _CLASS[raw]
    here = np.flatnonzero(codes[1:-1])
    grams = (_GRAM[codes[here] * 155 + codes[here + 1]] + _NEXT[codes[here + 2]]) % BUCKETS
    first = np.flatnonzero(codes[here] == 0)
    text_first = np.searchsorted(here[first], bounds)
    return grams, np.append(first, len(here)), text_first


def _texts(docs: DataFrame, text_col: str):
    return F.concat(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit("\n"))


def _held_out(id_col: str, folds: int, fold: int):
    left = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return F.coalesce(left == fold, F.lit(False))


class LanguageModel:
    """Languages in order, and the log-likelihood of every n-gram number in each."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs


def learn_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    fold: int = 2,
) -> LanguageModel:
    """Count the n-grams of all documents with a language, except the held-out ones.

    What reaches the driver is one number for each language and n-gram number. Over
    ``LANGUAGES`` different languages is an error.
    """
    known = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        _texts(docs, text_col).alias("text"),
    ).where(F.col("lang").isNotNull() & ~_held_out("id", folds, fold))

    def scan(batches):
        counts: dict[str, np.ndarray] = {}
        for part in pieces(batches):
            grams, word_first, text_first = _letters(part.column("text"))
            per_text = np.diff(word_first[text_first])
            langs = part.column("lang").dictionary_encode()
            code = np.repeat(langs.indices.to_numpy(), per_text).astype(np.int64)
            for n, lang in enumerate(langs.dictionary.to_pylist()):
                found = np.bincount(grams[code == n], minlength=BUCKETS)
                counts[lang] = counts[lang] + found if lang in counts else found
        for lang, found in counts.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(found[some])],
                names=["lang", "gram", "n"],
            )

    counts = known.select("lang", "text").mapInArrow(scan, "lang string, gram long, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique().tolist())
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {LANGUAGES} are supported")
    found = np.zeros((BUCKETS, len(names)))
    place = {name: n for n, name in enumerate(names)}
    found[table["gram"].to_numpy(dtype=np.int64), table["lang"].map(place).to_numpy(dtype=np.int64)] = table["n"]
    logs = np.log((found + 0.5) / (found.sum(axis=0) + 0.5 * BUCKETS))
    return LanguageModel(names, logs.astype(np.float32))


def _rows_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.stack([group_sums(values[:, k].astype(np.float64), first) for k in range(values.shape[1])], axis=1)


def _mixture(odds, top, first, start):
    """EM from the given proportions: proportions and log-likelihood of each text."""
    share = start
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    for _ in range(ROUNDS):
        weighted = odds * share[text_of].astype(np.float32)
        total = np.maximum(weighted.sum(axis=1), np.float32(1e-30))
        share = _rows_sum(weighted / total[:, None], first) / np.maximum(counts, 1)[:, None]
    total = (odds * share[text_of]).sum(axis=1)
    return share, group_sums(np.log(np.maximum(total, 1e-300)) + top, first)


def _take(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words of the chosen texts, and where each text begins among them."""
    counts = np.diff(first)[rows]
    begin = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(begin[-1]) - np.repeat(begin[:-1] - first[rows], counts), begin


def text_languages(column: pa.Array, model: LanguageModel) -> np.ndarray:
    """Proportions of the chosen languages of each text (rows of zeros for texts without words)."""
    grams, word_first, first = _letters(column)
    texts, langs = len(first) - 1, len(model.names)
    share = np.zeros((texts, langs))
    if not langs or not len(grams):
        return share
    likely = np.add.reduceat(model.logs[grams], word_first[:-1], axis=0).astype(np.float64)
    top = likely.max(axis=1)
    odds = np.exp(likely - top[:, None]).astype(np.float32)
    counts = np.diff(first)
    cost = PENALTY * np.log1p(counts)
    alone = _rows_sum(likely, first)
    best = alone.argmax(axis=1)
    value = alone.max(axis=1)
    share[np.arange(texts), best] = 1.0
    share[counts == 0] = 0.0
    if langs == 1:
        return share
    mixed, upper = _mixture(odds, top, first, np.full((texts, langs), 1.0 / langs))
    # No set of two or more can do better than all languages together less one penalty.
    open_ = np.flatnonzero((upper - cost + 1.0 > value) & (counts > 0))
    rank = np.argsort(-mixed, axis=1, kind="stable")
    for size in range(2, langs + 1):
        open_ = open_[upper[open_] - (size - 1) * cost[open_] + 1.0 > value[open_]]
        if not len(open_):
            break
        at, begin = _take(open_, first)
        start = np.zeros((len(open_), langs))
        np.put_along_axis(start, rank[open_, :size], 1.0 / size, axis=1)
        part, gain = _mixture(odds[at], top[at], begin, start)
        gain = gain - (size - 1) * cost[open_]
        better = gain > value[open_]
        value[open_[better]] = gain[better]
        share[open_[better]] = part[better]
    return share


def languages(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 4,
    fold: int = 2,
) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score``, ``langs``, ``shares``.

    ``langs`` are the chosen languages, largest proportion (``shares``) first; ``lang_pred``
    is the first one and ``score`` its proportion. Equal proportions go by name. A text that
    is null, has no letters, or meets a model without languages is ``und`` with score 0.
    A null id is never held out. Repeated rows give repeated results.
    """

    def scan(batches):
        for part in pieces(batches):
            share = text_languages(part.column("text"), model)
            share[~part.column("lettered").to_numpy(zero_copy_only=False)] = 0.0
            langs, shares = [], []
            for row in share:
                order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
                langs.append([model.names[k] for k in order])
                shares.append([min(1.0, float(row[k])) for k in order])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["id", "langs", "shares"],
            )

    lettered = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), _texts(docs, text_col).alias("text"), lettered.alias("lettered")
    )
    found = texts.mapInArrow(scan, "id long, langs array<string>, shares array<double>")
    return found.select(
        F.col("id").alias(id_col),
        _held_out("id", folds, fold).alias("held_out"),
        F.coalesce(F.get("langs", F.lit(0)), F.lit("und")).alias("lang_pred"),
        F.coalesce(F.get("shares", F.lit(0)), F.lit(0.0)).alias("score"),
        "langs",
        "shares",
    )
