"""Edit-aware token counts.

A document keeps a segment tree over runs of pre-tokens: each leaf has the
characters and tokens of its run, each inner node the sums of its two
children.  Runs end only before white space that follows another character;
no pre-token of the byte-level vocabularies crosses such a place and none
looks past it, so the counts of runs add up to the count of the text.

An edit re-encodes the runs it touches, with the characters next to the edit
as boundary context, and the sums above them; the rest of the text is not
encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches
from .tokens import JSON_FILE, RANKS_FILE, encode

#: Characters after which a run ends at the next place where it may.
RUN_CHARS = 512
#: Edits of ``redactions``: what is replaced, and by what.  Fixed values.
REDACTED = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b[0-9a-f]{32,}\b", "[SECRET]"),
    (r"\+?[0-9][0-9 ()-]{6,}[0-9]", "[NUMBER]"),
]

#: Where a run may end: before white space of either definition that follows neither.
_END = regex.compile(r"(?<=[^\s\p{Z}\p{C}])(?=\s)")


def runs(text: str) -> list[str]:
    """The text cut into runs; one that has no place to end is left whole."""
    out, at = [], 0
    while len(text) - at > RUN_CHARS:
        m = _END.search(text, at + RUN_CHARS)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class Tree:
    """Sums of characters and tokens over the runs of a text."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, (max(1, len(chars)) - 1).bit_length())
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(chars)] = chars
        self.tokens[self.size : self.size + len(tokens)] = tokens
        self.leaves = max(1, len(chars))
        for values in (self.chars, self.tokens):
            n = self.size
            while n > 1:
                values[n // 2 : n] = values[n : 2 * n : 2] + values[n + 1 : 2 * n : 2]
                n //= 2

    @classmethod
    def of(cls, text: str, count) -> Tree:
        parts = runs(text)
        return cls([len(p) for p in parts], [count(p) for p in parts])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at ``place`` and the leaf's start."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and start + self.chars[node] < self.chars[1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.chars[node], self.tokens[node] = chars, tokens
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def edit(self, text: str, begin: int, end: int, new: str, count) -> tuple[str, int]:
        """Replace text[begin:end]; the new text and the characters encoded again."""
        if not len(text):
            self.put(0, len(new), count(new) if new else 0)
            return new, len(new)
        last_char = len(text) - 1
        first, start = self.leaf_at(min(max(0, begin - 1), last_char))
        last, at = self.leaf_at(min(end, last_char))
        stop = at + int(self.chars[self.size + last])
        edited = text[:begin] + new + text[end:]
        region = edited[start : stop + len(new) - (end - begin)]
        # the touched run takes the region; the runs it swallowed stay as empty leaves
        self.put(first, len(region), sum(count(p) for p in runs(region)))
        for leaf in range(first + 1, last + 1):
            if self.chars[self.size + leaf]:
                self.put(leaf, 0, 0)
        return edited, len(region)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that hide personal data and secrets, in text order, none overlapping."""
    found = sorted((m.start(), m.end(), new) for pattern, new in REDACTED for m in regex.finditer(pattern, text))
    out: list[tuple[int, int, str]] = []
    for begin, end, new in found:
        if not out or begin >= out[-1][1]:
            out.append((begin, end, new))
    return out


_TREE = "n_tokens long, run_chars array<int>, run_tokens array<int>"


def _counter(json_file: str, ranks_file: str | None):
    return lambda text: len(encode(text, json_file, ranks_file))


def with_trees(docs: DataFrame, json_file: str = JSON_FILE, ranks_file: str | None = RANKS_FILE) -> DataFrame:
    """doc_id, text and the leaves of each row's tree; the tree's inner sums follow from them.

    A null text is empty: no runs, no tokens.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(json_file, ranks_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                chars, tokens = [], []
                for text in batch.column("text").to_pylist():
                    parts = runs(text)
                    chars.append([len(p) for p in parts])
                    tokens.append([count(p) for p in parts])
                total = pa.array([sum(t) for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), total, pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                    ["doc_id", "text", "n_tokens", "run_chars", "run_tokens"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text string, {_TREE}")


def recount(trees: DataFrame, edits, json_file: str = JSON_FILE, ranks_file: str | None = RANKS_FILE) -> DataFrame:
    """Token counts after edits, from trees made before them.

    Args:
        trees: as ``with_trees`` returns them, or read back from a table.
        edits: function of a text giving (begin, end, new) by character, in
            text order and not overlapping; or the name of a column of
            ``trees`` with an array of such structs.

    Returns doc_id, n_tokens (before), n_edits, n_tokens_edited, n_chars_edited
    and n_chars_encoded, the characters that had to be encoded again.  A row
    without edits keeps its count and encodes nothing.  Edits beyond the text
    are cut to it.  Repeated rows are counted alike.
    """
    given = edits if isinstance(edits, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(json_file, ranks_file)
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "n_tokens", "run_chars", "run_tokens")]
            own = batch.column(given).to_pylist() if given else None
            for i, (doc_id, text, before, chars, tokens) in enumerate(zip(*columns, strict=True)):
                todo = [tuple(e.values()) for e in own[i] or []] if own else edits(text)
                again = 0
                after, n_chars = before, len(text)
                if todo:
                    tree, n = Tree(chars, tokens), len(text)
                    # from the end, so that the places of earlier edits stay
                    for begin, end, new in reversed(todo):
                        begin = min(max(0, begin), n)
                        text, encoded = tree.edit(text, begin, min(max(begin, end), n), new or "", count)
                        again += encoded
                    after, n_chars = int(tree.tokens[1]), len(text)
                rows.append((doc_id, before, len(todo), after, n_chars, again))
            names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]
            values = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names)

    return trees.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def edited_counts(docs: DataFrame, edits=redactions, json_file: str = JSON_FILE, ranks_file: str | None = RANKS_FILE) -> DataFrame:
    """Counts before and after ``edits`` in one pass; columns other than doc_id and text are ignored."""
    return recount(with_trees(docs, json_file, ranks_file), edits, json_file, ranks_file)
