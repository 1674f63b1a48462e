"""License scans: exact phrases, and a set-similarity join with templates.

Text blocks are all runs of consecutive words as long as the template and the
share of other words that CONTAINMENT leaves room for, wherever lines end.  A
template is found in a block if the block's word set holds at least
``CONTAINMENT`` percent of the template's word set.  The join is exact and
filtered as set-similarity joins are: template words are ordered by their
frequency over the whole corpus, rarest first; a text can qualify only if it
holds a word of the template's prefix (prefix filter) and enough of its words
(length filter); a block begins with a word of the template (positional
filter).  Survivors are verified on full sets.

Everything runs as DataFrame functions.  The templates are a list in the code
or a caller's; they travel inside the plan, TEMPLATES_AT_ONCE in one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels, fixed values.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Templates of the method, fixed values: words of usual notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]
CONTAINMENT = 80
#: Templates in one expression; more of them make more expressions.
TEMPLATES_AT_ONCE = 200

#: Word characters and others, for texts in any case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _pattern(phrase: str) -> str:
    return f"(?i)(?<!{WORD}){f'{BREAK}+'.join(phrase.split())}(?!{WORD})"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{BREAK}+"), "")


def _size(template: str) -> int:
    return len(set(template.split()))


def _needed(size: int) -> int:
    """Fewest shared words: ceil(CONTAINMENT percent of the template's)."""
    return -(-CONTAINMENT * size // 100)


def _frequencies(rows: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """Documents that hold each template word, over all rows.

    At most as many rows as the templates have words reach the driver; counts
    are combined before the shuffle.
    """
    known = sorted({w for _, t in templates for w in t.split()})
    hits = rows.select(F.explode(F.array_intersect(_words(F.lower("text")), _strings(known))).alias("word"))
    return {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _ordered(template: str, found: dict[str, int]) -> list[str]:
    """The template's word set, rarest first."""
    return sorted(set(template.split()), key=lambda w: (found.get(w, 0), w))


def _prefix(template: str, found: dict[str, int]) -> list[str]:
    """The rarest words, of which a block that qualifies holds one."""
    words = _ordered(template, found)
    return words[: len(words) - _needed(len(words)) + 1]


def _in_runs(text: Column, templates: list[tuple[str, str]], found: dict[str, int]) -> Column:
    """Label and containment of each template that qualifies in a run of words, by its best run."""
    entry = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                _strings(words).alias("words"),
                _strings(_prefix(template, found)).alias("prefix"),
                F.lit(_needed(len(words))).alias("needed"),
                F.lit(-(-100 * len(template.split()) // CONTAINMENT)).alias("length"),
            )
            for label, template in templates
            for words in [_ordered(template, found)]
        ]
    )

    def best(e: Column, words: Column) -> Column:
        # a run that qualifies can be cut to one that begins with a word of the template
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains(e["words"], F.element_at(words, i)))
        return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(e["words"], F.slice(words, i, e["length"])))))

    def runs(words: Column, held: Column) -> Column:
        # a run holds no word that the text doesn't
        near = F.filter(entry, lambda e: F.arrays_overlap(held, e["prefix"]) & (F.size(F.array_intersect(e["words"], held)) >= e["needed"]))
        shares = F.transform(
            near,
            lambda e: F.struct(e["label"].alias("label"), best(e, words).alias("shared"), F.size(e["words"]).alias("size"), e["needed"].alias("needed")),
        )
        kept = F.filter(shares, lambda x: x["shared"] >= x["needed"])
        return F.transform(kept, lambda x: F.struct(x["label"].alias("label"), (x["shared"] / x["size"]).alias("share")))

    # an array of one, so that the words are made once
    texts = F.array(_words(F.translate(text, _UPPER, _LOWER)))
    return F.flatten(F.transform(texts, lambda words: runs(words, F.array_distinct(words))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """License labels of each row of ``docs``.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the best containment, 1 where a phrase stands, else 0), and
    blocks, the labels and containments found.

    Edge cases: a null text is empty: no words, no labels (empty strings), null
    first_word and last_word.  Several templates of one label count once.
    Repeated rows are scanned alike.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _frequencies(rows, templates)
    wanted = sorted({w for _, t in templates for w in _prefix(t, found)} | {p.split()[0] for p, _ in phrases})
    rows = rows.withColumn("words", _words(F.lower("text")))
    rows = rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.arrays_overlap("words", _strings(wanted)).alias("maybe")
    )
    text, maybe = F.col("text"), F.col("maybe")
    none = F.lit(None).cast("long")
    for i, (phrase, _) in enumerate(phrases):
        rows = rows.withColumn(f"n{i}", F.when(maybe, F.regexp_count(text, F.lit(_pattern(phrase)))).otherwise(0).cast("long"))
    for i, (phrase, _) in enumerate(phrases):
        there = F.col(f"n{i}") > 0
        first = F.size(_words(F.element_at(F.split(text, _pattern(phrase), 2), 1)))
        last = F.size(_words(F.regexp_extract(text, f"(?s)^(.*){_pattern(phrase)}", 1)))
        rows = rows.withColumn(f"f{i}", F.when(there, first.cast("long")).otherwise(none))
        rows = rows.withColumn(f"l{i}", F.when(there, last.cast("long")).otherwise(none))
    nothing = F.array().cast("array<struct<label:string,share:double>>")
    rows = rows.withColumn("blocks", nothing)
    for at in range(0, len(templates), TEMPLATES_AT_ONCE):
        part = templates[at : at + TEMPLATES_AT_ONCE]
        rows = rows.withColumn("blocks", F.concat("blocks", F.when(maybe, _in_runs(text, part, found)).otherwise(nothing)))
    base = F.filter(
        F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull()
    )
    base = F.array_sort(F.array_distinct(base))
    n_base = sum((F.col(f"n{i}") for i in range(1, len(phrases))), F.col("n0"))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.array(*[F.col(f"f{i}") for i in range(len(phrases))])).alias("first_word"),
        F.array_max(F.array(*[F.col(f"l{i}") for i in range(len(phrases))])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("blocks", lambda b: b["label"]))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(best).alias("score"),
        "blocks",
    )


def oracle() -> str:
    """DuckDB SQL for the scan: all runs of words of each text against the templates it has enough words of."""
    word, gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    words = lambda x: f"regexp_extract_all({x}, '{word}+')"
    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x.split()) + "]"
    phrase_rows = ", ".join(f"('{label}', {listed(p)})" for p, label in PHRASES)
    template_rows = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), {len(t.split())})" for label, t in TEMPLATES)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, {words('t')} AS words FROM d
), p(label, phrase) AS (VALUES {phrase_rows}
), places AS (
  SELECT rid, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS place FROM w, p
), base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY rid
), tpl(label, words, size) AS (VALUES {template_rows}
), near AS (
  SELECT rid, w.words AS held, label, tpl.words AS own, size FROM w, tpl
  WHERE 100 * len(list_intersect(tpl.words, list_distinct(w.words))) >= {CONTAINMENT} * len(tpl.words)
), runs AS (
  SELECT rid, label, own, held[i : i + cast(ceil(100 * size / {CONTAINMENT}::DOUBLE) AS BIGINT) - 1] AS run FROM (SELECT *, unnest(range(1, len(held) + 1)) AS i FROM near)
), found AS (
  SELECT rid, label, len(list_intersect(own, list_distinct(run))) / len(own) AS share FROM runs
  WHERE 100 * len(list_intersect(own, list_distinct(run))) >= {CONTAINMENT} * len(own)
), more AS (
  SELECT rid, list_distinct(list(label)) AS labels, max(share) AS best FROM found GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""
