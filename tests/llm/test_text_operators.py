"""Quality, toxicity, packing, token counts, decontamination."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siteweave.llm import decontaminate, packing, quality, token_counts, toxicity
from siteweave.llm.tokens import encode, exact

ODD = [None, "", " \n ", "one", "x" * 70_000, "word " * 20_000, "<|endoftext|> a <|endoftext|>", "日本語 текст 😀\u200b", "a\r\nb\tc\x0bd", "\n\n\n  \n"]


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "src", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


# quality ------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_like_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c", "é ", "\n", "# ", "the ", " \t"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    for r in quality.quality(docs(spark, texts)).collect():
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def prose(rng, n=120):
    syllables = "ter an ing ed ou st re la mo ni".split()
    made = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 5)))
    pick = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else made()
    return " ".join(pick() for _ in range(n)).capitalize() + "."


def plain_distance(p, q):
    m = (p + q) / 2
    kl = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum()
    return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_quality_distances_and_verdicts(spark):
    rng = random.Random(8)
    good = [prose(rng) for _ in range(40)]
    junk = [" ".join(w + rng.choice(["%%%", "&&&", "***", "$$$"]) for w in prose(rng).split()) for _ in range(4)] + [prose(rng).upper().replace(" ", "!! ")]
    texts = good + junk
    got = {r.doc_id: r for r in quality.quality(docs(spark, texts)).collect()}
    assert [got[i].kept for i in range(len(texts))] == [not got[i].base_failed for i in range(40)] + [False] * 5
    assert sum(got[i].kept for i in range(40)) > 30
    m = quality.measures(pa.array(texts))
    own = [np.append(c, 0) / max(1, c.sum()) for c in m["chars"]]
    passed = [i for i in got if not got[i].base_failed]
    first = np.mean([own[i] for i in passed], axis=0)
    near = [i for i in passed if plain_distance(own[i], first) <= quality.NEAR_DISTANCE]
    assert 30 < len(near) < len(passed)
    ref = np.mean([own[i] for i in near], axis=0)
    for i in range(len(texts)):
        assert got[i].char_distance == pytest.approx(plain_distance(own[i], ref), abs=1e-6)
    kept = quality.passing(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)


def test_quality_without_language_or_rows(spark):
    df = docs(spark, ["short", None] + [prose(random.Random(1))] * 2, None)
    assert [r.kept for r in quality.quality(df).orderBy("doc_id").collect()] == [False, False, True, True]
    assert quality.quality(df.drop("lang")).count() == 4 and quality.quality(df.limit(0)).count() == 0
    assert quality.passing(df.withColumnRenamed("source", "kept")).count() == 2


# toxicity -----------------------------------------------------------------------


def labelled(n=300, seed=3):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkface", "blargh"]))
        # the word for a group goes with the label in the sample, not in the world
        if rng.random() < (0.7 if bad else 0.1):
            words.insert(rng.randrange(len(words)), "muslim")
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_learns_and_holds_out(spark):
    texts, y = labelled()
    df = docs(spark, texts + [None, "", "ZORKFACE! blargh"])
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(len(y)) if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[len(y)].score == got[len(y) + 1].score < 0.5 < got[len(y) + 2].score
    keep = toxicity.acceptable(df, labels)
    assert keep.columns == df.columns and keep.count() == sum(r.predicted == 0 for r in got.values())


def test_toxicity_never_reads_held_out_labels(spark):
    texts, y = labelled(120)
    df = docs(spark, texts)
    flip = lambda i, v: 1 - v if toxicity.held_out(i) else v
    frames = [spark.createDataFrame([(i, f(i, v)) for i, v in enumerate(y)], "doc_id long, toxic int") for f in (lambda i, v: v, flip)]
    a, b = (sorted(tuple(r) for r in toxicity.toxicity(df, f).collect()) for f in frames)
    assert a == b


def gaps_and_accuracy(texts, y, learn, pairs):
    """Mean change of the logit over the pairs, and accuracy on rows that were not learnt from."""
    w = toxicity.fit([texts[i] for i in learn], y[learn].astype(float))
    logit = lambda p: np.log(p / (1 - p))
    a, b = (logit(toxicity.scores(pa.array([p[k] for p in pairs]), w)) for k in (0, 1))
    rest = np.setdiff1d(np.arange(len(texts)), learn)
    predicted = toxicity.scores(pa.array([texts[i] for i in rest]), w) >= 0.5
    return float(np.abs(a - b).mean()), float((predicted == y[rest]).mean())


def test_swapping_identity_terms_changes_scores_less_with_the_penalty(monkeypatch):
    texts, y = labelled()
    learn, pairs = np.arange(0, 300, 2), [("a muslim neighbour came", "a christian neighbour came")]
    gap, right = gaps_and_accuracy(texts, np.array(y), learn, pairs)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    plain_gap, plain_right = gaps_and_accuracy(texts, np.array(y), learn, pairs)
    assert gap < 0.7 * plain_gap and right >= plain_right - 0.02


def test_counterfactuals_differ_in_terms_only():
    rng = random.Random(4)
    terms = {w for groups in toxicity.IDENTITY_TERMS.values() for g in groups for w in g}
    met = set()
    for text in [prose(rng, 30) for _ in range(600)] + ["Old men. No one.\nThe GAY uncle, a Muslim!", "x"]:
        pairs = toxicity.counterfactuals(text, toxicity.IDENTITY_TERMS)
        assert pairs
        for a, b in pairs:
            a, b = re.findall(r"\w+", a), re.findall(r"\w+", b)
            unlike = [(x, z) for x, z in zip(a, b, strict=True) if x != z]
            assert unlike and all(x in terms and z in terms for x, z in unlike)
            met |= {x for x, _ in unlike}
    assert met == terms
    assert toxicity.counterfactuals("old men. no one.", toxicity.IDENTITY_TERMS) == [("old men", "young girls")]
    assert toxicity.counterfactuals(" . ", toxicity.IDENTITY_TERMS) == [] == toxicity.counterfactuals("a b", {})


def test_penalty_on_the_labelled_documents(spark, monkeypatch):
    """On documents of sf0.1 whose toxic ones name a group more often, swaps move scores less at equal accuracy."""
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id")
    rows = known.where("n_chars < 3000").select("doc_id", "text", "toxic").orderBy("doc_id").collect()[:1200]
    rng = random.Random(6)
    texts, y = [], np.array([r.toxic for r in rows])
    for r in rows:
        named = rng.random() < (0.6 if r.toxic else 0.05)
        texts.append(f"{r.text} The muslim came." if named else r.text)
    assert all(toxicity.counterfactuals(t, toxicity.IDENTITY_TERMS) for t in texts if t.strip(". \n"))
    learn = np.arange(0, len(texts), 2)
    pairs = [(f"{r.text} A muslim came.", f"{r.text} A christian came.") for r in rows[1:200:2]]
    gap, right = gaps_and_accuracy(texts, y, learn, pairs)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    plain_gap, plain_right = gaps_and_accuracy(texts, y, learn, pairs)
    print(gap, plain_gap, right, plain_right)
    assert gap < 0.7 * plain_gap and right >= plain_right - 0.01


def test_training_rows_are_bounded_by_rows(spark):
    """Repeated ids do not multiply the sample; the same rows give the same weights whatever their order."""
    texts, y = labelled(60)
    df = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    many = df.unionByName(df).unionByName(df)
    a, b = toxicity.train(many, labels, 50), toxicity.train(many.orderBy("n_chars", "text"), labels, 50)
    assert np.array_equal(a, b)


def test_toxicity_without_labels_or_rows(spark):
    df = docs(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(df, none).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(df.limit(0), none).count() == 0


# packing and tokens -------------------------------------------------------------


def test_fast_ids_are_the_exact_ids():
    rng = random.Random(6)
    alphabet = ["a", "B", " ", "  ", "\n", "é", "ß", "'s", "12", "!?", "\t", "\u00a0", "Ω", "<|", "x" * 50, "\r\n", "ñ", "0", "_"]
    texts = ODD[1:] + ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(400)] + ["z" * 30_000, " " * 30_000]
    for t in texts:
        assert encode(t).tolist() == exact().encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_ROWS", 20)
    rng = random.Random(7)
    texts = ODD + [" ".join(rng.choices(["alpha", "beta", "gamma", "42"], k=rng.randrange(90))) for _ in range(80)] + ["same words here"] * 9
    df = docs(spark, texts)
    df = df.unionByName(df.where("doc_id = 20")).withColumnRenamed("source", "offset")
    n = 64
    rows = packing.pack(df, n, with_ids=True).collect()
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= n and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= n
    by_doc = {}
    for r in sorted({r[:2]: tuple(r) for r in rows}.values(), key=lambda r: r[1]):
        by_doc.setdefault(r[0], []).append(r)
    assert sum(r.doc_id == 20 for r in rows) == 2 * len(by_doc[20])
    for i, t in enumerate(texts):
        want = np.append(encode(t), np.uint32(0)).tolist()
        parts = by_doc[i]
        assert [p[1] for p in parts] == list(range(len(parts)))
        assert [x for p in parts for x in np.frombuffer(p[7], "<u4").tolist()] == want
        assert [p[2] for p in parts] == [s for s, _ in packing.cut(len(want), n)]
    assert len(sequences) <= -(-sum(r.length for r in rows) // n) + 1
    assert packing.pack(df.limit(0)).count() == 0


def best_fit_decreasing(sizes, top):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else top) - s)
    return len(gaps)


def test_successors_like_a_stack():
    rng = random.Random(1)
    for _ in range(50):
        rows = sorted((-rng.randrange(1, 30), rng.random() < 0.5) for _ in range(rng.randrange(1, 60)))
        free, want = [], set()
        for i, (_, piece) in enumerate(rows):
            if not piece:
                free.append(i)
            elif free:
                want.add((free.pop(), i))
        slots, pieces = packing.successors(np.array([p for _, p in rows]))
        assert set(zip(slots.tolist(), pieces.tolist(), strict=True)) == want
        assert all(rows[s][0] <= rows[p][0] for s, p in want)


def test_carried_ranks_like_a_stack():
    rng = random.Random(2)
    for _ in range(50):
        counts = [(p, rng.randrange(5), rng.randrange(5)) for p in range(rng.randrange(1, 8))]
        free, want, left = [], {}, []
        for part, waiting, slots in counts:
            for i in range(waiting):
                if free:
                    want[part, i] = free.pop()
                else:
                    left.append((part, i))
            free += [(part, i) for i in range(slots)]
        ranges, rest = packing.carried(counts)
        got = {(p, i): (s, top - (i - first)) for p, first, last, s, top, _ in ranges for i in range(first, last + 1)}
        assert got == want
        assert len({key + i for _, first, last, _, _, key in ranges for i in range(last - first + 1)}) == len(want)
        served, ranks = {p: n for p, n, _ in rest}, {p: r for p, _, r in rest}
        assert [ranks[p] + i - served[p] for p, i in left] == list(range(len(left)))


@pytest.mark.parametrize("kind", ["mixed", "large", "equal", "one"])
def test_rounds_like_serial_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "LEAST_ROWS", 50)
    rng = random.Random(3)
    top = 128
    sizes = {
        "mixed": [rng.choice([top, rng.randrange(1, top + 1), rng.randrange(1, 20)]) for _ in range(400)],
        "large": [rng.randrange(40, 90) for _ in range(200)],
        "equal": [43] * 90 + [64] * 31,
        "one": [1],
    }[kind]
    light = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    placed = [tuple(r) for part in packing._packed(light, top) for r in part.collect()]
    assert sorted((u, n) for u, _, n in placed) == list(enumerate(sizes))
    used = Counter()
    for _, sequence, n in placed:
        used[sequence] += n
    assert max(used.values()) <= top and set(used) == set(range(len(used)))
    assert len(used) <= 1.02 * best_fit_decreasing(sizes, top) + 1


def test_token_trees_after_edits(spark):
    rng = random.Random(5)
    pieces = ["a", " ", "\n", "  ", "é", ".", "'s", "12", "\n\n", "x y", "", "Ω "]
    count = lambda t: len(encode(t))
    for text in ["", "a", prose(rng, 400), "  \n\n " * 300, "x" * 3000, prose(rng, 200) + "\n\n\n" + prose(rng, 200)]:
        tree = token_counts.Tree.of(text, count)
        assert tree.tokens[1] == count(text)
        for _ in range(25):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 3, 700]))
            new = "".join(rng.choices(pieces, k=rng.randrange(4)))
            text, _ = tree.edit(text, a, b, new, count)
            assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))


def test_edited_counts(spark):
    texts = ODD + [prose(random.Random(i), 500) + " mail bob@example.com or +1 555 123 4567 now " + prose(random.Random(i), 500) for i in range(4)]
    for r in token_counts.edited_counts(docs(spark, texts)).collect():
        text = texts[r.doc_id] or ""
        edits = token_counts.redactions(text)
        new = text
        for a, b, x in reversed(edits):
            new = new[:a] + x + new[b:]
        assert (r.n_tokens, r.n_edits, r.n_tokens_edited, r.n_chars_edited) == (len(encode(text)), len(edits), len(encode(new)), len(new))
        assert (r.n_chars_encoded > 0) == bool(edits)
        if len(edits) == 2:
            assert r.n_chars_encoded < len(text) / 2
    given = token_counts.with_trees(docs(spark, ["abc def"])).selectExpr("*", "array(named_struct('begin', 0, 'end', 99, 'new', 'x')) as edits")
    assert token_counts.recount(given, "edits").first().n_tokens_edited == 1


# decontamination ----------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(9)
    items = [" ".join(f"{rng.choice('bcdfg')}{rng.randrange(900)}" for _ in range(40)) for _ in range(6)] + ["tiny item", None, "", " ".join(f"long{i}" for i in range(900))]
    w = items[0].split()
    edited = " ".join(x if i % 8 else "changed" for i, x in enumerate(w))
    gone = " ".join(x for i, x in enumerate(w) if i % 9)
    filler = prose(rng, 300)
    texts = [
        f"{filler} {items[0].upper()}! {filler}", f"{filler} {edited} {filler}", f"{gone}\n{filler}", filler, None, "", " ".join(w[:20]), f"{filler} tiny, ITEM {filler}",
        f"{items[2]} {filler} {items[3]} {items[2]}", " ".join(x if i % 3 else "no" for i, x in enumerate(w)), items[9],
    ]
    df = docs(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, items[1], 1)], "item_id long, text string, score long")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (7, 6), (8, 2), (8, 3), (10, 9)}
    assert got[0, 0].similarity == got[0, 0].score == 1.0 and got[1, 0].similarity == pytest.approx(35 / 40)
    assert (got[0, 0].first_word, got[0, 0].last_word) == (300, 339)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == len(texts)


def test_leaks_in_blocks_and_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    rng = random.Random(2)
    items = [prose(rng, 30) for _ in range(8)]
    texts = [f"{prose(rng, 50)} {items[3]}" for _ in range(60)] + [f"{items[5]} end", prose(rng, 80)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert {(i, 3) for i in range(60)} | {(60, 5)} == got


def test_leaks_with_frequent_seeds_only(spark):
    """One document holds the whole item or one chance seed of it, many hold the same edited passage."""
    item = [f"w{i}" for i in range(40)]
    edited = " ".join(item[:20] + ["changed"] + item[21:])
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    for other, found in ((" ".join(item), {20}), ("a " + " ".join(item[18:23]) + " b", set())):
        got = decontaminate.leaks(docs(spark, [edited] * 20 + [other]), bench)
        assert {r.doc_id for r in got.collect()} == set(range(20)) | found


def test_alignment_like_the_textbook():
    rng = random.Random(4)
    for _ in range(60):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 14))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 20))], np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = 2 if a[i - 1] == b[j - 1] else -1
                table[i, j] = max(0, table[i - 1, j - 1] + s, table[i - 1, j] - 1, table[i, j - 1] - 1)
        score, matched, first, end = decontaminate.align(a, b)
        assert score == table.max() and matched <= len(a) and (score == 0 or first < end)
