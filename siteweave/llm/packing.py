"""Bulk-synchronous best-fit packing of tokenised documents.

Pieces and gaps are two tables that are sorted by size over range partitions.
A round takes the longest pieces still unplaced, a class of similar sizes:

  1. Gaps offer slots: as many as hold any piece of the class, and what is
     left over if that may still hold one.
  2. Slots and pieces are range-sorted together, largest first.  Each
     partition sweeps its range: a piece takes its successor, the smallest
     free slot that holds it; pieces that want one slot get it by their rank.
  3. Pieces without a slot in their partition take those that partitions of
     larger sizes have left, again by rank.  Only the two counts of each
     partition meet, the rows are joined on their common rank.
  4. Pieces that no gap holds open new sequences, no more than any packing
     of them needs.  Gaps shrink by what they got, and the next round begins.

Rounds are bounded by the number of classes and end when no piece is left;
each is written, so a lost executor costs one step.  The driver sees counts
only: of lengths (at most max_length), of gaps by steps of room, of partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import small_batches, written
from .tokens import JSON_FILE, RANKS_FILE, encode

MAX_LENGTH = 2048
END_ID = 0
#: Longest to shortest piece of a class, while a piece fills more than 1 / COARSE_BELOW of a sequence and beyond.
FINE, COARSE, COARSE_BELOW = 1.5, 16, 8
#: Gaps are counted by their slots: none, and from each of these numbers on.
STEPS = [1, 4, 16, 64, 256]
#: Rows of a sweep's partition: at least these while cores are free, at most those.
LEAST_ROWS, MOST_ROWS = 25_000, 1_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, max_length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a shorter first."""
    first = n % max_length or min(n, max_length)
    starts = [0, *range(first, n, max_length)]
    return [(s, (starts[i + 1] if i + 1 < len(starts) else n) - s) for i, s in enumerate(starts)]


def pieces(docs: DataFrame, max_length: int, json_file: str, ranks_file: str | None, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = np.append(encode(text.as_py(), json_file, ranks_file), np.uint32(END_ID)).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), max_length)):
                        own = ids[start : start + length].tobytes()
                        for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(own), own), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:n], kinds[:n], strict=True)], names[:n])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, _PIECES + (", ids binary" if with_ids else "")
    )


def successors(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched slots and pieces in rows sorted from the largest size, slots first.

    A piece takes the last free slot before it, the smallest that holds it:
    slots and pieces match as brackets do.
    """
    depth = np.cumsum(np.where(is_piece, -1, 1))
    level = np.where(is_piece, depth + 1, depth)
    # within a level slots and pieces alternate
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    match = (level[a] == level[b]) & ~is_piece[a] & is_piece[b]
    return a[match], b[match]


def _swept(rows: DataFrame, parts: int) -> DataFrame:
    """Matches within each range: part, uid, bin, length; what is left has a null bin or uid, and its place idx.

    A row without uid and bin has the part's waiting pieces in length and its free slots in idx.
    """
    by = [F.desc("size"), F.asc("is_piece"), F.desc("tie"), F.asc("id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        is_piece = table.column("is_piece").combine_chunks().to_numpy(zero_copy_only=False)
        ids, size, part = (table.column(c).to_numpy() for c in ("id", "size", "part"))
        slot, piece = successors(is_piece)
        free = np.ones(len(ids), bool)
        free[slot] = free[piece] = False
        slots, waiting = np.flatnonzero(free & ~is_piece), np.flatnonzero(free & is_piece)
        none = lambda n: pa.nulls(n, pa.int64())
        for uid, bins, at, idx in (
            (pa.array(ids[piece]), pa.array(ids[slot]), piece, none(len(piece))),
            (none(len(slots)), pa.array(ids[slots]), slots, pa.array(np.arange(len(slots)))),
            (pa.array(ids[waiting]), none(len(waiting)), waiting, pa.array(np.arange(len(waiting)))),
            (none(1), none(1), None, pa.array([len(slots)])),
        ):
            if at is None:
                size, at = np.array([len(waiting)]), np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), uid, bins, pa.array(size[at]), idx], ["part", "uid", "bin", "length", "idx"])

    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return dealt.select(F.spark_partition_id().alias("part"), "size", "is_piece", "id").mapInArrow(
        run, "part int, uid long, bin long, length long, idx long"
    )


def carried(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Ranges of pieces and of the slots they take from partitions of larger sizes.

    ``counts`` has (part, waiting pieces, free slots), by part.  Returns the
    ranges (piece part, first, last, slot part, slot of the first, key of the
    first; later pieces take the slots before), and (part, pieces served, rank
    of the next) of each part.
    """
    stack: list[list[int]] = []
    ranges, rest, key, rank = [], [], 0, 0
    for part, waiting, slots in counts:
        done = 0
        while done < waiting and stack:
            n = min(waiting - done, stack[-1][1])
            ranges.append((part, done, done + n - 1, stack[-1][0], stack[-1][1] - 1, key))
            done, key = done + n, key + n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        rest.append((part, done, rank))
        rank += waiting - done
        if slots:
            stack.append([part, slots])
    return ranges, rest


def _across(spark: SparkSession, left: DataFrame, ranges: list[tuple]) -> DataFrame:
    """Matches (uid, bin, length) between the rows that partitions have left."""
    table = spark.createDataFrame(pa.table(list(map(list, zip(*ranges, strict=True))), ["p", "first", "last", "s", "top", "key"]))
    pieces = left.where("bin is null").join(table, F.expr("part = p and idx between first and last"))
    slots = left.where("uid is null").join(table, F.expr("part = s and idx between top - (last - first) and top"))
    return pieces.select("uid", "length", F.expr("key + idx - first").alias("k")).join(
        slots.select("bin", F.expr("key + top - idx").alias("k")), "k"
    ).select("uid", "bin", "length")


def _lowest(top: int, max_length: int) -> int:
    """Sizes above this one are in the class of ``top``."""
    if top <= COARSE:
        return 0
    return int(top / FINE) if top * COARSE_BELOW > max_length else top // COARSE


def _offered(gaps: DataFrame, top: int, low: int, wanted: int) -> tuple[DataFrame | None, int]:
    """Slots of the gaps, smallest rooms first, until there are as many as pieces; and how many."""
    room, each = F.col("room"), F.floor(F.col("room") / top)
    # gaps by the number of slots they have for any piece
    spans = list(zip([0, *STEPS], [*STEPS, None], strict=True))
    within = lambda a, b: (each >= a) if b is None else (each >= a) & (each < b)
    sums = [F.sum(F.when(within(a, b), v)).alias(f"{k}{a}") for a, b in spans for k, v in (("gaps", 1), ("slots", each))]
    near = gaps.where(room > low)
    known = near.agg(*sums).first()
    sure, n, most, share = 0, 0, None, 0
    for a, b in spans:
        held, slots = known[f"gaps{a}"] or 0, known[f"slots{a}"] or 0
        # gaps with more room can wait once there are enough; of the last ones each gives its share
        most, share = b, max(1, -(-(wanted - sure) // held)) if held else 1
        n, sure = n + held + min(slots, held * share), sure + slots
        if sure >= wanted:
            break
    if not n:
        return None, 0
    last = spans[[b for _, b in spans].index(most)][0]
    full = F.when(each >= max(1, last), F.least(each, F.lit(share))).otherwise(each)
    rest = room - top * each
    slots = F.concat(F.array_repeat(F.lit(top).cast("long"), full.cast("int")), F.when(rest > low, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    offered = (near if most is None else near.where(each < most)).select("bin", "room", F.explode(slots).alias("size"))
    # of equal slots, those of the smaller gap come last and are taken first
    return offered.select("size", F.lit(False).alias("is_piece"), F.col("bin").alias("id"), F.col("room").alias("tie")), n


def _matched(current: DataFrame, offered: DataFrame | None, total: int) -> tuple[DataFrame, DataFrame | None]:
    """Matches (uid, bin, length) of pieces with slots, and the pieces without: (uid, length, rank)."""
    spark = current.sparkSession
    rows = current.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), F.col("uid").alias("id"), F.lit(0).cast("long").alias("tie"))
    if offered is not None:
        rows = rows.unionByName(offered)
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = written(_swept(rows, max(1, -(-total // MOST_ROWS), min(cores, total // LEAST_ROWS))))
    left = swept.where("idx is not null and (uid is not null or bin is not null)")
    # one row of each partition
    found = swept.where("uid is null and bin is null").select("part", "length", "idx").collect()
    counts = sorted((r["part"], r["length"], r["idx"]) for r in found)
    ranges, rest = carried(counts)
    matched = swept.where("uid is not null and bin is not null").select("uid", "bin", "length")
    if ranges:
        matched = written(matched.unionByName(_across(spark, left, ranges)))
    unserved = [r for r, c in zip(rest, counts, strict=True) if c[1] > r[1]]
    if not unserved:
        return matched, None
    table = spark.createDataFrame(pa.table(list(map(list, zip(*unserved, strict=True))), ["p", "served", "base"]))
    ranked = left.where("bin is null").join(table, F.expr("part = p and idx >= served"))
    return matched, ranked.select("uid", "length", F.expr("base + idx - served").alias("rank"))


def _packed(light: DataFrame, max_length: int) -> list[DataFrame]:
    """Placements (uid, bin, length) of each round, for pieces (uid, length)."""
    untouched = {r["length"]: r["n"] for r in light.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    gaps, waiting, n_waiting, longest, bins, high = None, None, 0, 0, 0, max_length
    out = []
    while waiting is not None or any(k <= high for k in untouched):
        top = longest if waiting is not None else max(k for k in untouched if k <= high)
        low = _lowest(top, max_length)
        current = light.where((F.col("length") > low) & (F.col("length") <= high))
        n = sum(v for k, v in untouched.items() if low < k <= high) + n_waiting
        if waiting is not None:
            current = current.unionByName(waiting)
        offered, n_slots = _offered(gaps, top, low, n) if gaps is not None else (None, 0)
        matched, ranked = _matched(current, offered, n + n_slots)
        if offered is not None:
            changes = gaps.unionByName(matched.select("bin", (-F.col("length")).alias("room")))
            gaps = written(changes.groupBy("bin").agg(F.sum("room").alias("room")).where("room > 0"))
            out.append(matched)
        waiting, n_waiting, high = None, 0, low
        if ranked is None:
            continue
        left = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("volume"), F.max("length").alias("longest")).first()
        longest, n_waiting = left["longest"], left["n"]
        if gaps is None or gaps.where(F.col("room") >= longest).isEmpty():
            # no gap holds the longest: open sequences, no more than any packing of these pieces needs
            each = max_length // longest
            opened = min(-(-n_waiting // each), max(-(-left["volume"] // max_length), -(-n_waiting // (max_length // (low + 1)))))
            own = ranked.where(F.col("rank") < opened * each)
            own = own.select("uid", F.expr(f"{bins} + floor(rank / {each})").cast("long").alias("bin"), "length")
            new = written(own.groupBy("bin").agg((F.lit(max_length) - F.sum("length")).alias("room")).where("room > 0"))
            gaps = new if gaps is None else gaps.unionByName(new)
            bins += opened
            out.append(own)
            ranked = ranked.where(F.col("rank") >= opened * each)
            n_waiting = max(0, n_waiting - opened * each)
            longest = ranked.agg(F.max("length")).first()[0] if n_waiting else 0
        if n_waiting == n:
            raise RuntimeError("a round placed nothing")
        waiting = ranked.select("uid", "length") if n_waiting else None
    return out


def pack(
    docs: DataFrame,
    max_length: int = MAX_LENGTH,
    json_file: str = JSON_FILE,
    ranks_file: str | None = RANKS_FILE,
    with_ids: bool = False,
) -> DataFrame:
    """Place every piece of every document in a sequence of at most max_length ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset; with ``with_ids`` also ids, the piece's little-endian 32-bit ids,
    at the cost of shuffling them once.

    Edge cases: a null or empty text is one piece, the end id.  Rows that
    repeat a doc_id are packed like any others.  A null doc_id stays null.
    An empty table gives no rows.  Columns other than doc_id and text are
    ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    table = written(pieces(docs, max_length, json_file, ranks_file, with_ids).withColumn("uid", F.monotonically_increasing_id()))
    # sorted files: a round reads those of its class
    light = written(table.select("uid", "length").repartitionByRange("length", "uid").sortWithinPartitions("length"))
    rounds = _packed(light, max_length)
    names = [c for c in table.columns if c not in ("uid", "ids")] + ["sequence_id", "offset"] + ["ids"] * with_ids
    if not rounds:
        return table.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).select(*names)
    placed = rounds[0].withColumn("round", F.lit(0))
    for i, part in enumerate(rounds[1:], 1):
        placed = placed.unionByName(part.withColumn("round", F.lit(i)))
    before = Window.partitionBy("bin").orderBy("round", F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    places = placed.select("uid", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return table.join(places, "uid").select(*names)
