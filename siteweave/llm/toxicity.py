"""Toxicity: a counterfactually regularised classifier, trained here.

Features are hashed letter runs of the whole text and their beginnings, with
the logarithm of their counts.  A logistic model is fitted to labelled
documents under two penalties: the usual one on weights, and one on score
changes between sentences that differ in an identity term only.

Every labelled document gives such pairs.  Its sentences that mention a term
of ``IDENTITY_TERMS`` are paired with those where each term is swapped for
another of its group.  If it has none, one of its sentences gets a slot, and
the pair is that sentence with one term in the slot and with another.
Fitting uses a bounded sample of labelled rows; scoring reads all texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches
from ._words import U64, Words, chunks, mix, text_buffer

#: Labelled rows that a fit may read at most, drawn by hash of the id.
MAX_TRAIN = 8000
#: Fold that is never learnt from: crc32(id as text) mod FOLDS = 0.
FOLDS = 5
BITS = 18
#: Bytes of the beginnings that count as features beside whole runs.
STARTS = (4, 6, 7)
WEIGHT_PENALTY = 1e-4
SWAP_PENALTY = 30.0
STEPS = 120
SPEED = 0.1
#: Rows that a feature must be met in, and its least log odds.
LEAST_ROWS, LEAST_ODDS = 5, 1.0
#: Parts of the sample for scores out of fold.
INNER = 3
#: Terms by language and group; a swap takes another of its group.  Fixed values; a caller's own replace them.
IDENTITY_TERMS = {
    "en": [
        "women men girls boys".split(),
        "christian muslim jewish hindu buddhist atheist".split(),
        "black white asian latino african european".split(),
        "gay straight lesbian bisexual transgender".split(),
        "old young elderly teenage".split(),
        "immigrant native refugee foreign".split(),
        "deaf blind disabled".split(),
    ],
    "de": ["frauen männer mädchen jungen".split(), "christlich muslimisch jüdisch hinduistisch".split(), "schwul lesbisch bisexuell".split(), "ausländisch einheimisch geflüchtet".split()],
    "fr": ["femmes hommes filles garçons".split(), "chrétien musulman juif hindou".split(), "homosexuel lesbienne bisexuel".split(), "étranger immigré réfugié".split()],
    "es": ["mujeres hombres niñas niños".split(), "cristiano musulmán judío hindú".split(), "homosexual lesbiana bisexual".split(), "extranjero inmigrante refugiado".split()],
}

_LETTERS = re.compile(r"[^\W\d_]+")
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = True
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_BREAK = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every letter run, one column per feature; run bounds."""
    words = Words(_BREAK[data[offsets[0] : offsets[-1]]], offsets - offsets[0], lower=True)
    columns = [words.hashes]
    for width in STARTS:
        start = np.zeros(len(words.begin), U64)
        for j in range(width):
            at = np.minimum(words.begin + j, len(words.data) - 1)
            byte = np.where(words.begin + j < words.end, words.data[at], 0).astype(U64)
            start = start * U64(257) + byte
        columns.append(mix(start + U64(width << 56)))
    table = np.stack(columns, axis=1) if len(words.begin) else np.zeros((0, len(STARTS) + 1), U64)
    return (table >> U64(64 - BITS)).astype(np.int32), words.bounds


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and the logarithms of their counts."""
    data, offsets = text_buffer(texts)
    for first, last in chunks(offsets):
        table, bounds = _hashed(data, offsets[first : last + 1])
        for i in range(last - first):
            ids, counts = np.unique(table[bounds[i] : bounds[i + 1]], return_counts=True)
            yield ids, np.log1p(counts).astype(np.float32)


def counterfactuals(text: str, terms: dict[str, list[list[str]]]) -> list[tuple[str, str]]:
    """Pairs of sentences of the text that differ in identity terms only.

    Sentences that mention terms are paired with their swaps.  A text without
    any gets two terms of one group into a slot of one of its sentences;
    sentence, slot and terms follow from the text's hash, so all groups of all
    languages are met over many texts.  A text without words gives no pair.
    """
    groups = [g for language in sorted(terms) for g in terms[language] if len(g) > 1]
    following = {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}
    sentences = [s for s in text.lower().replace("\n", ".").split(".") if s.strip()]
    pairs = []
    for sentence in sentences:
        words = _LETTERS.findall(sentence)
        if any(w in following for w in words):
            pairs.append((sentence, _LETTERS.sub(lambda m: following.get(m[0], m[0]), sentence)))
    if not pairs and sentences and groups:
        at = zlib.crc32(text.encode())
        words = sentences[at % len(sentences)].split()
        group = groups[at // 7 % len(groups)]
        slot, first = at // 11 % (len(words) + 1), at // 13 % len(group)
        fill = lambda term: " ".join([*words[:slot], term, *words[slot:]])
        pairs.append((fill(group[first]), fill(group[(first + 1) % len(group)])))
    return pairs


def _difference(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([a[0], b[0]])
    values = np.concatenate([a[1], -b[1]])
    distinct, at = np.unique(ids, return_inverse=True)
    total = np.bincount(at, weights=values, minlength=len(distinct))
    keep = total != 0
    return distinct[keep], total[keep].astype(np.float32)


class _Sparse:
    """Rows of features; products with a weight vector."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.ids = np.concatenate([r[0] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([r[1] for r in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=self.values * w[self.ids], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, weights=self.values * g[self.owner], minlength=size)


def fit(texts: list[str | None], labels: np.ndarray, terms: dict[str, list[list[str]]] | None = None) -> np.ndarray:
    """Weights of the features, then the intercept.  Equal rows give equal weights."""
    terms = IDENTITY_TERMS if terms is None else terms
    size = 1 << BITS
    own = [s or "" for s in texts]
    found = np.zeros(size, np.int32)
    rows = []
    for row in _bags(pa.array(own, pa.large_string())):
        found[row[0]] += 1
        rows.append(row)
    # features of few rows cannot be learnt from and are most of all: they go before anything is built
    for i, (ids, values) in enumerate(rows):
        keep = found[ids] >= LEAST_ROWS
        rows[i] = (ids[keep], values[keep])
    swaps = [p for s in own for p in counterfactuals(s, terms)]
    left = list(_bags(pa.array([a for a, _ in swaps], pa.large_string())))
    right = list(_bags(pa.array([b for _, b in swaps], pa.large_string())))
    apart = _Sparse([_difference(a, b) for a, b in zip(left, right, strict=True)])
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return np.append(np.zeros(size), np.log(rate / (1 - rate)))
    # scores out of fold say how far to trust the margins
    part = np.arange(len(y)) % INNER
    z = np.zeros(len(y))
    for k in range(INNER):
        learn, test = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if 0 < y[learn].sum() < len(learn):
            w = _margins([rows[i] for i in learn], y[learn], apart)
            z[test] = _Sparse([rows[i] for i in test]).dot(w)
    slope, shift = _calibrated(z, y)
    return np.append(_margins(rows, y, apart) * slope, shift)


def _margins(rows: list, y: np.ndarray, apart: _Sparse) -> np.ndarray:
    """Weights of the logistic model on features scaled by their log odds.

    Features met in fewer than LEAST_ROWS rows or with odds near one are left
    out: they would only remember single documents.
    """
    size = 1 << BITS
    x = _Sparse(rows)
    found = np.bincount(x.ids, minlength=size)
    bad = np.bincount(x.ids, weights=y[x.owner], minlength=size)
    n_bad, n_good = y.sum(), len(y) - y.sum()
    odds = np.log((bad + 1) / (n_bad + 2)) - np.log((found - bad + 1) / (n_good + 2))
    odds[(found < LEAST_ROWS) | (np.abs(odds) < LEAST_ODDS)] = 0
    keep = odds[x.ids] != 0
    x.ids, x.values, x.owner = x.ids[keep], x.values[keep] * odds[x.ids[keep]], x.owner[keep]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias, seen, seen_b = np.zeros(size), 0.0, np.full(size, 1e-12), 1e-12
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40)))
        error = (p - y) * balance
        grad = x.back(error, size) + WEIGHT_PENALTY * w
        if apart.n:
            grad += SWAP_PENALTY * odds * apart.back(apart.dot(w * odds) / apart.n, size)
        seen += grad * grad
        w -= SPEED * grad / np.sqrt(seen)
        step = float(error.sum())
        seen_b += step * step
        bias -= SPEED * step / np.sqrt(seen_b)
    return w * odds


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into the share of toxic rows."""
    scale = max(1e-9, float(np.abs(z).max()))
    z = z / scale
    slope, shift = 1.0, float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        e, q = p - y, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, np.array([(e * z).sum() + 1e-3 * (slope - 1), e.sum()])), -1, 1)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-9:
            break
    return slope / scale, shift


def _fold(column) -> object:
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, terms: dict[str, list[list[str]]] | None = None) -> np.ndarray:
    """Fit to labelled documents outside the held-out fold.

    ``max_train`` bounds the sample, which is the rows of smallest hash of
    doc_id, whatever the table's size, also if documents repeat ids.  The
    sample's ids are broadcast (at most max_train of them) and one executor
    task fits; the driver gets the weights alone.  Rows with a null id, label
    or text have nothing to learn.  ``terms`` replaces ``IDENTITY_TERMS``.
    """
    small_batches(docs.sparkSession)
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(_fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # ids may repeat, so the rows are bounded too; the top rows are found in each partition before they meet
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    joined = joined.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        weights = fit([r[1] for r in rows], np.array([r[2] for r in rows], float), terms)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weights[at])], ["at", "weight"])

    learnt = joined.repartition(1).mapInArrow(run, "at int, weight double").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[learnt.column("at").to_numpy()] = learnt.column("weight").to_numpy()
    return weights


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Score of each whole text; a text without letters scores the intercept."""
    out = np.zeros(len(texts))
    for i, (ids, values) in enumerate(_bags(texts)):
        z = float((values * weights[ids]).sum()) + weights[-1]
        out[i] = 1 / (1 + np.exp(-min(40.0, max(-40.0, z))))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, terms: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Only doc_id and text of ``docs`` and doc_id and toxic of ``labels`` are
    read; other columns are ignored, whatever their names.  Edge cases: null
    and empty texts score the intercept, the base rate's logit.  A null doc_id
    gives a null held_out.  Repeated rows score alike; of labels that
    contradict each other the larger counts.  Without usable labels every
    score is 0.5.  An empty table gives no rows.
    """
    weights = train(docs, labels, max_train, terms).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, score double")
        .select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def _score_udf(shared):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, shared.value))

    return score


def acceptable(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they were; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train).astype(np.float32))
    return docs.where(_score_udf(shared)(F.coalesce(docs["text"].cast("string"), F.lit(""))) < limit)


def held_out(doc_id: int) -> bool:
    """Whether the id is in the fold that is never learnt from."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
