"""Quality rules: divergence of character and common-word histograms.

A document's histogram of character classes and its histogram of common words
are compared with the references of its language by Jensen-Shannon distance.
References are the mean histograms of all documents of the language that pass
the length and repetition guards, so they follow the corpus.  Documents below
the minimum length are never judged by divergence: their histograms are noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import free_name, small_batches, written
from ._words import Words, chunks, shingle_hashes, text_buffer

#: Common words by language, fixed values.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are as with be this by not from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas sur au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})

#: Character classes, by byte; bytes that continue a character have none.
CLASSES = ["lower", "upper", "digit", "space", "newline", "sentence", "quote", "mark", "control", "latin", "wide"]

MIN_WORDS = 50
#: Largest part of words, in percent, inside repeated windows of three words.
MAX_REPEATED = 50
#: Distance to the first mean within which a text counts for the reference.
NEAR_DISTANCE = 0.24
#: Jensen-Shannon distances to the language's references.  A text goes if its
#: characters alone are far off, or both its characters and words are off.
FAR_CHAR_DISTANCE = 0.26
OFF_CHAR_DISTANCE = 0.15
OFF_WORD_DISTANCE = 0.25


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), dtype=np.int64)
    table[0:0x20] = CLASSES.index("control")
    table[0x7F] = CLASSES.index("control")
    table[[0x20, 0x09]] = CLASSES.index("space")
    table[[0x0A, 0x0D]] = CLASSES.index("newline")
    table[0x30:0x3A] = CLASSES.index("digit")
    table[0x41:0x5B] = CLASSES.index("upper")
    table[0x61:0x7B] = CLASSES.index("lower")
    table[[ord(c) for c in ".,;:!?"]] = CLASSES.index("sentence")
    table[[ord(c) for c in "'\"()-"]] = CLASSES.index("quote")
    table[0x80:0xC0] = -1
    table[0xC0:0xE0] = CLASSES.index("latin")
    table[0xE0:] = CLASSES.index("wide")
    return table


_CLASS = _class_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _vocabulary_hashes() -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(pa.array(VOCABULARY))
    hashes = Words(data, offsets, lower=False).hashes
    order = np.argsort(hashes)
    return hashes[order], order


_KNOWN, _KNOWN_AT = _vocabulary_hashes()


def _repeated(words: np.ndarray) -> int:
    """Words inside windows of three that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    windows = shingle_hashes(words, 3)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(len(words), bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    covered = starts.copy()
    covered[1:] |= starts[:-1]
    covered[2:] |= starts[:-2]
    return int(covered.sum())


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _counts(before: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(before) + 1, np.int64)
    np.cumsum(before, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and histograms of each text; a null is an empty text."""
    data, offsets = text_buffer(texts)
    parts: list[dict] = []
    for first, last in chunks(offsets):
        own = offsets[first : last + 1]
        words = Words(data, own, lower=False)
        n = last - first
        bounds = own - own[0]
        raw = words.data
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(~_CONTINUES[raw], out=letters[1:])
        per_word = letters[words.end] - letters[words.begin]
        classes = _CLASS[raw] + np.repeat(np.arange(n) * len(CLASSES), np.diff(bounds))
        chars = np.bincount(classes[_CLASS[raw] >= 0], minlength=n * len(CLASSES)).reshape(n, -1)
        at = np.searchsorted(_KNOWN, words.hashes)
        at[at == len(_KNOWN)] = 0
        hit = _KNOWN[at] == words.hashes
        owner = np.repeat(np.arange(n), np.diff(words.bounds))
        common = np.bincount(owner[hit] * len(VOCABULARY) + _KNOWN_AT[at[hit]], minlength=n * len(VOCABULARY)).reshape(n, -1)
        whole = raw.tobytes()
        parts.append(
            {
                "n_words": np.diff(words.bounds),
                "word_chars": _counts(per_word, words.bounds),
                "n_symbols": _counts(_SYMBOL[raw].astype(np.int64), bounds),
                "n_dup_lines": np.array([_repeated_lines(whole[bounds[i] : bounds[i + 1]]) for i in range(n)], np.int64),
                "n_repeat_words": np.array([_repeated(words.hashes[words.bounds[i] : words.bounds[i + 1]]) for i in range(n)], np.int64),
                "chars": chars,
                "common": common,
            }
        )
    if not parts:
        return {"chars": np.zeros((0, len(CLASSES)), np.int64), "common": np.zeros((0, len(VOCABULARY)), np.int64)} | {
            k: np.zeros(0, np.int64) for k in COUNTS
        }
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _rows(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width), pa.int32()), pa.array(values.ravel().astype(np.int64)))


def measured(docs: DataFrame, key: str | None = "doc_id") -> DataFrame:
    """Key (0 without one), language and measures of each row, by one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *[pa.array(m[k]) for k in COUNTS], _rows(m["chars"]), _rows(m["common"])],
                ["doc_id", "lang", *COUNTS, "chars", "common"],
            )

    kind = docs.schema[key].dataType.simpleString() if key else "int"
    own = F.col(key) if key else F.lit(0)
    return docs.select(own.alias("doc_id"), _lang(docs).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, lang string, {', '.join(f'{k} long' for k in COUNTS)}, chars array<long>, common array<long>",
    )


def _lang(docs: DataFrame) -> object:
    return F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _shares(values, whole) -> object:
    """A histogram as shares of ``whole``, the rest as one more bin."""
    rest = whole - F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(values, F.array(rest)), lambda x: x / F.greatest(whole, F.lit(1)))


def _distance(p, q) -> object:
    """Jensen-Shannon distance in [0, 1]: root of the divergence in bits."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(rows: DataFrame) -> DataFrame:
    """Mean histograms by language: of all rows that pass the guards, then of those near these means.

    The second round keeps the references those of the language's prose,
    however much of the corpus is something else, as long as it is less.
    """
    guarded = rows.where(~F.col("base_failed")).select("lang", "char_shares", "word_shares")
    first = written(_means(guarded)).select("lang", "char_ref")
    near = guarded.join(first, "lang").where(_distance(F.col("char_shares"), F.col("char_ref")) <= NEAR_DISTANCE)
    found = written(_means(near.drop("char_ref")))
    # a language of which no row is near its mean keeps that mean
    return found.unionByName(_means(guarded.join(found, "lang", "left_anti")))


def _means(rows: DataFrame) -> DataFrame:
    """Mean histograms by language of rows with lang, char_shares and word_shares.

    A row for each language and bin meets its group as a sum and a count, so a
    language that holds most rows is summed before it is shuffled.
    """
    long = rows.select("lang", F.posexplode(F.concat("char_shares", "word_shares")).alias("bin", "share"))
    # sums of rounded shares are exact, so the references don't depend on row order
    means = long.groupBy("lang", "bin").agg((F.sum(F.round(F.col("share") * 1e9).cast("long")) / F.count(F.lit(1)) / 1e9).alias("share"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"])
    vectors = means.groupBy("lang").agg(ordered.alias("ref"))
    n = len(CLASSES) + 1
    return vectors.select("lang", F.slice("ref", 1, n).alias("char_ref"), F.slice("ref", n + 1, len(VOCABULARY) + 1).alias("word_ref"))


def _measure_columns(n_words, n_repeat_words, chars, common) -> dict[str, object]:
    n_chars = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: a + x)
    return {
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words),
        "char_shares": _shares(chars, n_chars),
        "word_shares": _shares(common, n_words),
    }


def _distances(char_shares, char_ref, word_shares, word_ref) -> tuple:
    return F.round(_distance(char_shares, char_ref), 9), F.round(_distance(word_shares, word_ref), 9)


def _passes(base_failed, chars_off, words_off) -> object:
    off = (chars_off > FAR_CHAR_DISTANCE) | ((chars_off > OFF_CHAR_DISTANCE) & (words_off > OFF_WORD_DISTANCE))
    return ~base_failed & ~F.coalesce(off, F.lit(False))


def _rows_of(docs: DataFrame, key: str | None) -> DataFrame:
    small_batches(docs.sparkSession)
    m = measured(docs, key)
    own = _measure_columns(F.col("n_words"), F.col("n_repeat_words"), F.col("chars"), F.col("common"))
    return m.select("doc_id", "lang", *COUNTS, *[c.alias(k) for k, c in own.items()])


def quality(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, guards, distances and verdict for each row of ``docs``.

    Returns doc_id, the five counts, base_failed, char_distance,
    word_distance and kept, one row per input row; the input's other columns
    are not touched, so their names cannot clash.

    Edge cases: a null text has no words, so it fails the length guard.  A row
    without language is compared with the rows without language.  Where no
    row of a language passes the guards there is no reference and none is
    needed.  Repeated rows are judged alike.  An empty table gives no rows.
    """
    rows = written(_rows_of(docs, key))
    chars, words = _distances(F.col("char_shares"), F.col("char_ref"), F.col("word_shares"), F.col("word_ref"))
    return (
        rows.join(written(references(rows)), "lang", "left")
        .withColumn("char_distance", chars)
        .withColumn("word_distance", words)
        .withColumn("kept", _passes(F.col("base_failed"), F.col("char_distance"), F.col("word_distance")))
        .select("doc_id", *COUNTS, "base_failed", "kept", "char_distance", "word_distance")
    )


def _measure_udf():
    @F.arrow_udf("struct<n_words: long, n_repeat_words: long, chars: array<long>, common: array<long>>")
    def measure(texts: pa.Array) -> pa.Array:
        m = measures(texts)
        return pa.StructArray.from_arrays(
            [pa.array(m["n_words"]), pa.array(m["n_repeat_words"]), _rows(m["chars"]), _rows(m["common"])],
            ["n_words", "n_repeat_words", "chars", "common"],
        )

    # said to be nondeterministic, so that a filter on it is not pushed below the join and run twice
    return measure.asNondeterministic()


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns as they were.

    Rows are judged where they stand; only the references, a row for each
    language, are joined to them.  Spark broadcasts these below its size
    threshold and else joins by language.
    """
    m_, lang, ref_chars, ref_words = (free_name(docs, n) for n in ("measures", "ref_lang", "ref_chars", "ref_words"))
    refs = written(references(written(_rows_of(docs, None).drop("doc_id", *COUNTS)))).toDF(lang, ref_chars, ref_words)
    m = docs.withColumn(m_, _measure_udf()(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    own = _measure_columns(*[F.col(m_)[k] for k in ("n_words", "n_repeat_words", "chars", "common")])
    joined = m.join(refs, _lang(docs) == F.col(lang), "left")
    chars, words = _distances(own["char_shares"], F.col(ref_chars), own["word_shares"], F.col(ref_words))
    return joined.where(_passes(own["base_failed"], chars, words)).drop(m_, lang, ref_chars, ref_words)
