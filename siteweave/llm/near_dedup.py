"""Near-duplicate components by SetSketch registers, banding and exact checks.

Method
  1. The set of word shingles of each text gives SetSketch registers: the
     minimum of exponential variates per register, stored as a truncated
     exponent in base ``BASE``.  Equal sets are collapsed to one node by a
     128-bit digest before anything is compared.
  2. Runs of ``ROWS`` registers form bands; nodes that share a band are
     candidates.  Every bucket becomes a star around its smallest node, so a
     bucket of n nodes gives n - 1 pairs, never n squared.
  3. Star pairs pass a joint likelihood test on their registers and known set
     sizes, then the exact test on their full sets.
  4. Buckets that the stars have not joined into one component may hide links
     between other members.  Members of each group of touching buckets are dealt into
     blocks of bounded size, and block pairs that span components are swept:
     same band test, same likelihood test, same exact test.  A task returns
     only the links of a spanning forest.
  5. Components of the confirmed links are found by star contraction.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, free_name, small_batches, written
from ._words import U64, Words, chunks, constants, shingle_hashes, text_buffer

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair is dropped unread only if its best similarity above the threshold is
#: exp(-MARGIN) times as likely as its best similarity overall.
MARGIN = 16.0
#: Nodes of one component or of small ones in a block of the sweep.
BLOCK = 256

_FACTORS = constants(REGISTERS, 21, odd=True)
_BLOCK_OF_SHINGLES = 512


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set given by the 64-bit hashes of its members.

    Registers of a union are the maxima of the parts' registers.
    """
    least = np.full(REGISTERS, np.iinfo(U64).max, dtype=U64)
    for at in range(0, len(shingles), _BLOCK_OF_SHINGLES):
        part = shingles[at : at + _BLOCK_OF_SHINGLES, None] * _FACTORS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    lowest = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(lowest) / math.log(BASE)), 0, TOP).astype(np.uint16)


_GRID = np.linspace(0.0, 1.0, 101)


def plausible(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether similarity >= percent/100 is not ruled out by the registers.

    ``more`` and ``less`` count registers in which a is above or below b.  The
    likelihood is the joint one of Ertl's SetSketch (2021) for known sizes:
    p(x) = -log_b(1 - x (b-1)/b) with x = u - vJ for "above", v - uJ for "below".
    """
    more, less = more.astype(float)[:, None], less.astype(float)[:, None]
    n_a, n_b = n_a.astype(float)[:, None], n_b.astype(float)[:, None]
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], most)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    value = more * log(up) + less * log(down) + (REGISTERS - more - less) * log(1 - up - down)
    fits = (_GRID[None, :] >= percent / 100 - 1e-9) & (_GRID[None, :] <= most + 0.01)
    best = np.where(fits, value, -np.inf).max(axis=1)
    return best >= value.max(axis=1) - MARGIN


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets: 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, offsets = text_buffer(batch.column("text"))
    for first, last in chunks(offsets):
        words = Words(data, offsets[first : last + 1], lower=True)
        for i in range(last - first):
            yield np.unique(shingle_hashes(words.hashes[words.bounds[i] : words.bounds[i + 1]], k))


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for found in _sets(batch, k):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(registers(found).astype(">u2").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "key", "n_shingles", "digest", "sketch"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, digest binary, sketch binary")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells apart the texts of a doc_id that is repeated."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "members"])

    return docs.mapInArrow(run, "node long, members binary")


def _u16(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u2").reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers allow the wanted similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _u16(batch.column("sketch_a")), _u16(batch.column("sketch_b"))
            keep = plausible((a > b).sum(1), (a < b).sum(1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("members_a"), batch.column("members_b")
            keep = [
                linked(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), percent)
                for x, y in zip(left, right, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _sweep(table: pa.Table, percent: int) -> pa.Table:
    """Links of a spanning forest between the components of one pair of blocks."""
    nodes = table.column("node").to_pylist()
    sketches = _u16(table.column("sketch"))
    sizes = table.column("n_shingles").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("members").to_pylist()]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    labels = table.column("component").to_pylist()
    out_a, out_b = [], []
    for i in range(len(nodes) - 1):
        roots = np.array([find(x) for x in labels[i + 1 :]])
        other = np.flatnonzero(roots != find(labels[i])) + i + 1
        if not len(other):
            continue
        same = sketches[other] == sketches[i]
        other_hit = same.reshape(len(other), BANDS, ROWS).all(2).any(1)
        other, same = other[other_hit], same[other_hit]
        if not len(other):
            continue
        more = (sketches[i] > sketches[other]).sum(1)
        less = (sketches[i] < sketches[other]).sum(1)
        fits = plausible(more, less, np.full(len(other), sizes[i]), sizes[other], percent)
        for j in other[fits]:
            x, y = find(labels[i]), find(labels[j])
            if x != y and linked(sets[i], sets[j], percent):
                parent[max(x, y)] = min(x, y)
                out_a.append(nodes[i])
                out_b.append(nodes[j])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _swept(groups: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the stars missed, from blocks of the groups still in parts."""
    members = groups.join(labels, "node", "left").select("node", "grp", F.coalesce("component", "node").alias("component"))
    members = written(members)
    open_groups = (
        members.groupBy("grp")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("n > 2 and lo <> hi")
        .select("grp")
    )
    inside = members.join(open_groups, "grp", "left_semi")
    parts = inside.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    # large components have blocks of their own, the small ones share blocks
    parts = parts.withColumn("own", F.when(F.col("n") >= BLOCK, F.col("component")))
    shares = parts.groupBy("grp", "own").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = (
        inside.join(parts.drop("n"), ["grp", "component"])
        .join(shares.drop("n").withColumnRenamed("grp", "g").withColumnRenamed("own", "o"), F.col("grp").eqNullSafe(F.col("g")) & F.col("own").eqNullSafe(F.col("o")))
        .withColumn("slot", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
        .select("grp", "node", "component", F.coalesce("own", F.lit(-1)).alias("own"), F.col("own").isNull().alias("mixed"), "slot")
    )
    dealt = written(dealt)
    blocks = dealt.select("grp", "own", "mixed", "slot").distinct()
    first, second = blocks.toDF("grp", "own", "mixed", "slot"), blocks.toDF("grp", "own2", "mixed2", "slot2")
    both = first.join(second, "grp").where(
        # each unordered pair of blocks once, and none inside one component
        "struct(mixed, own, slot) <= struct(mixed2, own2, slot2) and (mixed or mixed2 or own <> own2)"
    )
    both = both.withColumn("pair", F.xxhash64("grp", "own", "mixed", "slot", "own2", "mixed2", "slot2"))
    ends = both.select("pair", "grp", "own", "mixed", "slot").unionByName(
        both.select("pair", "grp", F.col("own2").alias("own"), F.col("mixed2").alias("mixed"), F.col("slot2").alias("slot"))
    ).distinct()
    rows = (
        dealt.join(ends, ["grp", "own", "mixed", "slot"])
        .select("pair", "node", "component")
        .join(nodes.select("node", "n_shingles", "sketch"), "node")
        .join(sets, "node")
        .select("pair", "node", "component", "n_shingles", "sketch", "members")
    )
    return rows.groupBy("pair").applyInArrow(lambda table: _sweep(table, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Component of each document among near copies.

    Args:
        docs: has doc_id and text; other columns are ignored, whatever their names.
        shingle: words in a shingle (five unless a caller's contract differs).
        percent: documents are linked if 100 * |A n B| >= percent * |A u B|.

    Returns one row per input row: doc_id, n_shingles, component_id, kept.

    Edge cases: a null or wordless text has no shingles, is linked with
    nothing and kept.  A text of fewer words than ``shingle`` has one shingle,
    all its words.  A null doc_id is judged unlinked, with a null component,
    and kept.  Rows repeating a doc_id are all returned; each is judged by its
    own text.  An empty table gives no rows.  Set members are 64-bit hashes of
    shingles, sets are equal if their 128-bit digests are.  A pair at the
    threshold escapes all bands with a chance below (1 - 0.8**5)**32 = 3e-6.
    """
    return _judged(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows of ``near_duplicates`` with key of the text, digest and grp, a node of the row's component."""
    small_batches(docs.sparkSession)
    signed = written(_signatures(docs, shingle))
    some = signed.where("digest is not null and doc_id is not null")
    sets_of = written(
        some.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        .select("digest", F.col("rep.doc_id").alias("least"), F.col("rep.key").alias("key"), "n_shingles", "sketch")
    )
    # a node is its smallest doc_id; unlike texts that repeat one are told apart by their digests
    shared = written(sets_of.groupBy("least").agg(F.min("digest").alias("owner"), F.max("digest").alias("other")).where("owner <> other").select("least", "owner"))
    other = F.when(F.col("digest") != F.col("owner"), F.xxhash64("least", "digest"))
    nodes = sets_of.join(shared, "least", "left").withColumn("node", F.coalesce(other, "least")).drop("owner")
    width = 2 * ROWS
    bands = nodes.select(
        "node",
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(BANDS)])).alias("bucket"),
    )
    # written, so that the join below reads both sides through plain exchanges and a hot bucket can be split
    hubs = written(bands.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("bucket", "a"))
    stars = written(bands.join(hubs, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    groups = written(components(stars).withColumnRenamed("component", "grp"))
    met = groups.select("node")
    sketched = written(nodes.join(met, "node", "left_semi").select("node", "n_shingles", "sketch"))
    side = lambda end: sketched.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
    likely = written(_estimated(stars.join(side("a"), "a").join(side("b"), "b"), percent))
    wanted = nodes.join(met, "node", "left_semi").select(F.col("least").alias("doc_id"), "key", "node")
    sets = written(_full_sets(_texts(docs).join(wanted, ["doc_id", "key"]).select("node", "text"), shingle))
    holds = lambda end: sets.select(F.col("node").alias(end), F.col("members").alias(f"members_{end}"))
    links = written(_confirmed(likely.join(holds("a"), "a").join(holds("b"), "b"), percent))
    labels = written(components(links))
    more = written(_swept(groups, labels, sketched, sets, percent))
    final = written(components(links.unionByName(more)))
    named = nodes.select("digest", "least", "node").join(final, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    # the smallest doc_id of a component, as its label may stand for a repeated one
    least = final.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    classes = named.join(least, "component", "left").select("digest", "grp", F.coalesce("first", "least").alias("first"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return (
        signed.select("doc_id", "key", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .select("doc_id", "key", "n_shingles", "digest", "grp", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, all columns as they were.

    The document of the smallest doc_id stays.  Rows that repeat a doc_id are
    judged by their own texts: one stays of those that are near copies or have
    no words.  Rows without doc_id cannot be told apart and stay.
    """
    found = written(_judged(docs, shingle, percent).where("doc_id is not null"))
    ids = written(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    own, key, grp = free_name(docs, "id"), free_name(docs, "key"), free_name(docs, "grp")
    gone = ids.where("not kept").select(F.col("doc_id").alias(own))
    same = docs["doc_id"].cast("long") == F.col(own)
    rest = docs.join(gone, same, "left_anti")
    twice = ids.where("kept and n > 1")
    if twice.isEmpty():
        return rest
    texts = found.where("kept").join(twice.select("doc_id"), "doc_id", "left_semi")
    texts = texts.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("grp").alias(grp)).distinct()
    keyed = F.xxhash64(docs["text"].cast("string")) == F.col(key)
    repeated = rest.join(texts, same & keyed).dropDuplicates(["doc_id", grp]).select(*[docs[c] for c in docs.columns])
    several = twice.select(F.col("doc_id").alias(own))
    return rest.join(several, same, "left_anti").unionByName(repeated)
