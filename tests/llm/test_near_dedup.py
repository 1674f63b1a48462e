import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siteweave.llm import near_dedup as nd
from siteweave.llm._spark import components
from siteweave.llm._words import Words, shingle_hashes, text_buffer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain(rows, k, percent):
    sets = [(d, plain_set(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(n, seed):
    """Texts in groups of copies: exact ones, chains of small edits, and a large group of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    base = lambda m: [rng.choice(words) for _ in range(m)]
    texts = [" ".join(base(rng.randrange(0, 60))) for _ in range(n)]
    for _ in range(12):
        t = base(rng.randrange(30, 200))
        for _ in range(rng.randrange(2, 7)):
            texts.append("  ".join(t) if rng.random() < 0.3 else " ".join(t).upper())
            t = list(t)
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
    t = base(120)
    for _ in range(60):
        s = list(t)
        for _ in range(rng.randrange(0, 5)):
            s[rng.randrange(len(s))] = rng.choice(words)
        texts.append("\n".join(s))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_like_all_pairs(spark, k, percent, seed):
    rows = corpus(60, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, k, percent).collect()}
    assert got == plain(rows, k, percent)
    assert len({c for _, c in got.values()}) < len(rows) - 30


def test_blocks_find_links_that_stars_miss(spark, monkeypatch):
    """A chain through a bucket: the smallest node is far from the others, which are near each other."""
    monkeypatch.setattr(nd, "BLOCK", 2)
    rows = corpus(5, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, 3, 85).collect()}
    assert got == plain(rows, 3, 85)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_like_all_pairs_on_the_tables(spark, k, percent):
    """All pairs of the 1,000 documents of sf0.01 that share a shingle, on their full sets."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {d: plain_set(t, k) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df, k, percent).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in ids}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4, 5, 6), (2, "a b c", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, id int, id_ int, node int, kept int, component int, digest int")
    got = nd.deduplicated(df, 3, 85)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [1]


def test_edge_cases(spark):
    rows = [(7, None, 1), (3, "", 2), (5, " \n\t", 3), (2, "a b", 4), (9, "A  B", 5), (4, "a b c", 6), (None, "a b c", 7), (4, "a b c", 8), (1, "x " * 30000 + "y", 9), (6, "x " * 30000 + "y", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, 3, 85).collect())
    assert got == [(-1, 1, None, True), (1, 2, 1, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (6, 2, 1, False), (7, 0, 7, True), (9, 1, 2, False)]
    kept = nd.deduplicated(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7]


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    """Texts of one doc_id: one alone, one a copy of another document, two alike, two of which share their smallest id."""
    alone, copied, alike = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(5, alone), (5, copied), (5, alike), (5, alike + " x"), (2, copied), (7, alike), (5, None), (5, " "), (9, alone)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, 3, 85).collect())
    same = [(2, 38, 2, True), (5, 0, 5, True), (5, 0, 5, True), (5, 38, 2, False), (5, 38, 5, True), (5, 38, 5, True), (5, 39, 5, True), (7, 38, 5, False), (9, 38, 5, False)]
    assert got == same
    kept = sorted((r.doc_id, (r.text or "").strip().removesuffix(" x")) for r in nd.deduplicated(df, 3, 85).collect())
    assert kept == sorted([(2, copied), (5, ""), (5, alone), (5, alike)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(1, 30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    ra, rb = nd.registers(a), nd.registers(b)
    assert (np.maximum(ra, rb) == nd.registers(x)).all()
    one = lambda p: nd.plausible(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2000]), np.array([2000]), p)[0]
    assert one(33) and not one(80)


def test_words_of_bytes():
    texts = ["Ab  cD\x0b\x0cé\u00a0x", "", None, " lead", "trail ", "a" * 100_000 + " b"]
    data, offsets = text_buffer(pa.array(texts))
    w = Words(data, offsets, lower=True)
    found = [[bytes(w.data[a:b]).decode() for a, b in zip(w.begin[i:j], w.end[i:j], strict=True)] for i, j in zip(w.bounds, w.bounds[1:], strict=False)]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    data, offsets = text_buffer(pa.array(["tireble ertible", "a b a b"]))
    w = Words(data, offsets, lower=True)
    assert w.hashes[0] != w.hashes[1] and len(set(shingle_hashes(w.hashes[2:], 2).tolist())) == 2
