"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

The words of test items give n-gram seeds.  One pass over the corpus joins
passages to items by seeds and aligns each passage's words with the item's: a
local alignment scores edited and paraphrased copies as well as literal ones.
No seed is left out, however many documents hold it: a copy may have none but
frequent ones.  Instead, a passage is aligned only if it holds enough of the
item's words for a copy, which loses nothing.

The items are a stated query set, held against all documents in blocks of
bounded size; each block is small enough to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches
from ._words import U64, Words, chunks, shingle_hashes, text_buffer

SEED_WORDS = 5
#: Similarity: share of the item's words that the alignment matches.
PERCENT = 80
#: Words of an item that are aligned at once; a longer item is held in parts.
PART_WORDS = 400
#: Letters of items in one block, the bound of what is broadcast.
BLOCK_CHARS = 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_LETTER = np.zeros(256, bool)
_LETTER[0x30:0x3A] = True
_LETTER[0x41:0x5B] = True
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_BREAK = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def _words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text; letters and digits make words, case does not count."""
    data, offsets = text_buffer(texts)
    for first, last in chunks(offsets):
        own = offsets[first : last + 1]
        words = Words(_BREAK[data[own[0] : own[-1]]], own - own[0], lower=True)
        for i in range(last - first):
            yield words.hashes[words.bounds[i] : words.bounds[i + 1]]


class Index:
    """Seeds of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items: list[int] = []
        self.words: list[np.ndarray] = []
        for (item, _), words in zip(items, _words(pa.array([t or "" for _, t in items], pa.large_string())), strict=True):
            for at in range(0, len(words), PART_WORDS):
                part = words[at : at + PART_WORDS]
                # a short rest is aligned together with the words before it
                part = words[max(0, at + len(part) - PART_WORDS) : at + len(part)] if at else part
                self.items.append(item)
                self.words.append(part)
        seeds = [shingle_hashes(w, SEED_WORDS) for w in self.words]
        self.widths = sorted({min(SEED_WORDS, len(w)) for w in self.words})
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, U64)
        self.part = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        self.place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.part, self.place = self.seed[order], self.part[order], self.place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seed >> U64(42)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word places of a text at which a seed stands, and the seeds' hashes."""
        places, seeds = [], []
        for width in self.widths:
            if len(words) < width:
                continue
            windows = shingle_hashes(words, width)
            at = np.flatnonzero(self.maybe[(windows >> U64(42)).astype(np.int64)])
            if not len(at):
                continue
            low = np.searchsorted(self.seed, windows[at])
            low[low == len(self.seed)] = 0
            at = at[self.seed[low] == windows[at]] if len(self.seed) else at[:0]
            places.append(at)
            seeds.append(windows[at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        return np.concatenate(places), np.concatenate(seeds)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, matched words, first and last word + 1 in the window."""
    n, m = len(item), len(window)
    if n <= m:
        # literal copies need no table
        for at in np.flatnonzero(window[: m - n + 1] == item[0]):
            if np.array_equal(window[at : at + n], item):
                return MATCH * n, n, int(at), int(at) + n
    steps = -GAP * np.arange(m + 1)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        row[1:] = table[i - 1, :-1] + np.where(window == item[i - 1], MATCH, MISMATCH)
        np.maximum(row, table[i - 1] + GAP, out=row)
        np.maximum(row, 0, out=row)
        # a gap in the item costs GAP for each word of the window
        table[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, matched, end = int(table[i, j]), 0, int(j)
    while i and j and table[i, j]:
        same = window[j - 1] == item[i - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, int(j), end


def found_in(words: np.ndarray, index: Index, percent: int = PERCENT) -> list[tuple[int, float, float, int, int]]:
    """(item, similarity, score, first word, last word) of the best alignment with each item found."""
    places, seeds = index.hits(words)
    if not len(places):
        return []
    low, high = np.searchsorted(index.seed, seeds, "left"), np.searchsorted(index.seed, seeds, "right")
    times = high - low
    entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    place = np.repeat(places, times)
    part, start = index.part[entry], place - index.place[entry]
    order = np.lexsort((start, part))
    part, start = part[order], start[order]
    best: dict[int, tuple] = {}
    i = 0
    while i < len(part):
        item = index.words[part[i]]
        slack = max(2, len(item) // 3)
        j = i
        while j + 1 < len(part) and part[j + 1] == part[i] and start[j + 1] - start[j] <= slack:
            j += 1
        # hits on close diagonals are one passage; a chain of them is cut into windows of bounded width
        a = int(start[i])
        while a <= start[j]:
            begin, end = max(0, a - slack), min(len(words), a + len(item) + 2 * slack)
            # no alignment matches more of the item's words than stand in the window
            if 100 * np.count_nonzero(np.isin(item, words[begin:end])) >= percent * len(item):
                score, matched, left, right = align(item, words[begin:end])
                row = (matched / len(item), score / (MATCH * len(item)), begin + left, begin + right - 1)
                name = index.items[part[i]]
                if 100 * matched >= percent * len(item) and (name not in best or row[:2] > best[name][:2]):
                    best[name] = row
            later = start[i : j + 1][start[i : j + 1] > a + slack]
            a = int(later[0]) if len(later) else int(start[j]) + 1
        i = j + 1
    return sorted((name, *row) for name, row in best.items())


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id is not null and text is not null"
    )
    total = rows.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def _text(docs: DataFrame):
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of a document and a test item it holds a copy of.

    Returns doc_id, item_id, similarity (the share of the item's words matched,
    ``percent`` / 100 at least), score (the alignment's, over that of a literal
    copy), first_word and last_word of the passage.

    Edge cases: items and documents with a null id or text, or without words,
    match nothing.  An item of fewer than five words has one seed, all its
    words.  An item longer than PART_WORDS is found if one of its parts is.
    Ties go to the first passage.  Repeated documents each have their rows.
    Empty tables give no rows.  Columns other than the two of each table are
    ignored, whatever their names.
    """
    found = None
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, *hit)
                    for doc, words in zip(batch.column("doc_id").to_pylist(), _words(batch.column("text")), strict=True)
                    if doc is not None
                    for hit in found_in(words, shared.value, percent)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "similarity", "score", "first_word", "last_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = _texts(docs).mapInArrow(run, "doc_id long, item_id long, similarity double, score double, first_word long, last_word long")
        found = part if found is None else found.unionByName(part)
    return found


def _is_clean(shared, percent: int):
    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([not found_in(words, shared.value, percent) for words in _words(texts)], pa.bool_())

    return judge


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, all columns as they were.

    Rows are judged where they stand: nothing is shuffled.  A null text is
    clean.  Columns keep their names and order, whatever they are.
    """
    for index in _blocks(benchmark):
        docs = docs.where(_is_clean(docs.sparkSession.sparkContext.broadcast(index), percent)(_text(docs)))
    return docs
