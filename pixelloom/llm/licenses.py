"""License scans: an exact set-similarity join between text blocks and license templates.

A block is a run of ``2 m`` words of a document, one starting every ``m`` words, where ``m`` is
the number of words of the longest template; so every run of ``m`` words lies whole in a block.
A template, the notice that a license asks for, is found in a block when the block holds at least
``THRESHOLD`` of its distinct words; short phrases are looked for word by word beside that.
Words are ordered by the number of documents that hold them, rarest first. A template can only be
contained in a block that holds one of its first ``size - needed + 1`` words (prefix filter), that
has at least ``needed`` template words (length filter), and whose matching word stands early
enough in both orders to leave room for the rest (position filter); what passes is counted out.

Texts never meet in a shuffle: blocks are cut in the task that reads the document, and the other
side of the join has a row per word of the fixed templates.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import same
from pixelloom.session import StoredTable

#: Runs of what is neither ASCII control, punctuation nor an upper-case ASCII letter.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8

PHRASES = {
    "mit": ["under the mit license"],
    "apache-2": ["apache license version 2"],
    "cc-by-nc": ["cc by nc"],
}
#: The notices that licenses ask for, as words; each is a template.
NOTICES = {
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at"
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"
    ],
    "cc-by-nc": [
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this "
        "license visit"
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation"
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software"
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at"
    ],
}

Templates = Mapping[str, Sequence[str]]


def scan_words(text: str = "text") -> Column:
    """Words of a text with A-Z lower-cased, a null text being empty.

    ``lower`` turns two other characters into ASCII letters; they are replaced by a letter that
    stays as it is, which keeps words apart from phrases as they were.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    for upper in ("\u212a", "\u0130"):  # Kelvin sign, dotted capital I
        plain = F.replace(plain, F.lit(upper), F.lit("\u00df"))
    return F.regexp_extract_all(F.lower(plain), F.lit(LICENSE_WORD), F.lit(0))


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand one after the other."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        found = F.get("_words", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get("_words", i + k) == part)
        return found

    last = F.size("_words") - len(parts)
    possible = (last >= 0) & (F.size(F.array_intersect("_known", _array(list(dict.fromkeys(parts))))) == len(set(parts)))
    none = F.array().cast("array<int>")
    return F.when(possible, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(none)


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def block_matches(
    blocks: DataFrame, ordered: Sequence[str], templates: Sequence[tuple[str, str]], threshold: float
) -> DataFrame:
    """Every ``(block columns, label, score)`` with ``score >= threshold``, a row per template found.

    ``blocks`` has the block's template words in ``words``; ``ordered`` lists all template words,
    rarest first.
    """
    rank = {w: i + 1 for i, w in enumerate(ordered)}
    rows = []
    for number, (label, text) in enumerate(templates):
        own = sorted({rank[w] for w in text.split()})
        needed = _needed(len(own), threshold)
        for at, r in enumerate(own[: len(own) - needed + 1], 1):
            rows.append((number, label, own, len(own), needed, at, r))
    prefixes = blocks.sparkSession.createDataFrame(
        rows, "template int, label string, own array<int>, size int, needed int, at int, rank int"
    )
    ranks = F.array_sort(F.transform("words", lambda w: F.array_position(_array(ordered), w).cast("int")))
    keys = [c for c in blocks.columns if c != "words"]
    probes = blocks.withColumn("_ranks", ranks).select(*keys, "_ranks", F.posexplode("_ranks").alias("_at", "rank"))
    n, i, j = F.size("_ranks"), F.col("at"), F.col("_at") + 1
    room = F.least(i, j) + F.least(F.col("size") - i, n - j) >= F.col("needed")
    overlap = F.size(F.array_intersect("_ranks", "own"))
    return (
        probes.join(prefixes, "rank")
        .filter((n >= F.col("needed")) & room)
        .withColumn("_overlap", overlap)
        .filter(F.col("_overlap") >= F.col("needed"))
        .select(*keys, "label", (F.col("_overlap") / F.col("size")).alias("score"))
    )


def scan_licenses(
    docs: DataFrame, phrases: Templates = PHRASES, notices: Templates = NOTICES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with the places of the phrases and all labels.

    A null text counts as empty; rows equal in id and text get equal results, rows that share
    only an id are judged apart, and a null id is an id. Other columns are ignored; an empty
    table gives no rows. ``score`` is 1 where a phrase stands, else the largest share of a notice's
    words found in a block, 0 where no notice reaches the threshold.
    """
    templates = [(label, t) for label in sorted(notices) for t in notices[label]]
    known = sorted({w for table in (phrases, notices) for ts in table.values() for t in ts for w in t.split()})
    longest = max(len(t.split()) for _, t in templates)
    parsed = docs.select("doc_id", F.xxhash64("text").alias("_key"), scan_words().alias("_words")).withColumn(
        "_known", F.array_intersect("_words", _array(known))
    )
    each = [(label, p) for label in sorted(phrases) for p in phrases[label]]
    at = [F.col(f"_at{k}") for k in range(len(each))]
    starts = F.concat(*at)
    found = [F.when(F.size(a) > 0, F.lit(label)) for a, (label, _) in zip(at, each)]
    based = parsed.select("*", *[_places(p).alias(f"_at{k}") for k, (_, p) in enumerate(each)])
    summary = StoredTable(
        based.select(
            "doc_id", "_key", F.size("_words").cast("bigint").alias("n_words"), "_known",
            F.size(starts).cast("bigint").alias("n_base"),
            F.array_min(starts).cast("bigint").alias("first_word"),
            F.array_max(starts).cast("bigint").alias("last_word"),
            F.array_distinct(F.array_compact(F.array(*found))).alias("_base"),
        )
    ).df

    # one count per template word comes back; they cover every document
    seen = {r[0]: r[1] for r in summary.select(F.explode("_known").alias("w")).groupBy("w").count().collect()}
    ordered = sorted(known, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    first: set[str] = set()
    for _, t in templates:
        own = sorted(set(t.split()), key=rank.get)
        first |= set(own[: len(own) - _needed(len(own), threshold) + 1])

    n = F.size("_words")
    begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / longest) - 2).cast("int"))
    blocks = (
        parsed.filter(F.arrays_overlap("_known", _array(sorted(first))))
        .select("doc_id", "_key", "_words", F.explode(begins).alias("_block"))
        .select(
            "doc_id", "_key", "_block",
            F.array_intersect(F.slice("_words", F.col("_block") * longest + 1, 2 * longest), _array(known)).alias("words"),
        )
    )
    hits = (
        block_matches(blocks, ordered, templates, threshold)
        .groupBy("doc_id", "_key")
        .agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    )
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", none)))
    s, h = summary.alias("s"), hits.alias("h")
    return s.join(h, same(F.col("s.doc_id"), F.col("h.doc_id")) & (F.col("s._key") == F.col("h._key")), "left").select(
        "s.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def check_sql(phrases: Templates = PHRASES, notices: Templates = NOTICES, threshold: float = THRESHOLD) -> str:
    """Every block against every template, without filters."""
    templates = [(label, t) for label in sorted(notices) for t in notices[label]]
    longest = max(len(t.split()) for _, t in templates)

    def listed(ws):
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]"

    values = ", ".join(f"('{label}', {listed(dict.fromkeys(t.split()))})" for label, t in templates)
    places = []
    for label in sorted(phrases):
        for p in phrases[label]:
            parts = p.split()
            cond = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts))
            places.append((label, f"list_filter(range(0, greatest(0, len(w) - {len(parts) - 1})), lambda i: {cond})"))
    starts = " || ".join(f"at{k}" for k in range(len(places)))
    names = ", ".join(f"case when len(at{k}) > 0 then '{label}' end" for k, (label, _) in enumerate(places))
    return f"""
with parsed as (
  select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{LICENSE_WORD}') as w from documents),
based as (select doc_id, k, w, {", ".join(f"{expr} as at{k}" for k, (_, expr) in enumerate(places))} from parsed),
base as (select doc_id, k, len(w) as n_words, {starts} as starts,
                list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))) as labels from based),
blocks as (select k, unnest(list_transform(range(0, greatest(1, cast(ceil(len(w) / {longest}) as bigint) - 1)),
                  lambda b: w[b * {longest} + 1 : b * {longest} + {2 * longest}])) as words from parsed),
templates(label, words) as (values {values}),
hits as (select k, label, len(list_intersect(list_distinct(b.words), t.words)) / len(t.words) as score
         from blocks b, templates t where len(list_intersect(list_distinct(b.words), t.words)) >= ceil({threshold} * len(t.words))),
found as (select k, list(distinct label) as labels, max(score) as score from hits group by k)
select doc_id, cast(n_words as bigint) as n_words, cast(len(starts) as bigint) as n_base, cast(list_min(starts) as bigint) as first_word,
       cast(list_max(starts) as bigint) as last_word, array_to_string(b.labels, ',') as base_labels,
       array_to_string(list_sort(list_distinct(b.labels || coalesce(f.labels, []))), ',') as labels,
       cast(case when len(b.labels) > 0 then 1 else coalesce(score, 0) end as double) as score
from base b left join found f on b.k = f.k
"""
