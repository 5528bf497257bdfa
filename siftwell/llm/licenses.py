r"""License scans by a positional index of rare words. SQL functions only.

Every passage of the index is a run of words that says which license holds, with key phrases that must be
there. A passage is posted under its rarest words, those with the highest inverse document frequency over
all documents, with their places in it. A document looks up the words it has: a word at place p that a
passage has at place q says that the passage would begin at p - q. A beginning that enough of the passage's
rare words agree on is a candidate, and is one place of the license if the key phrases stand, word for word,
at their places after it. The score of a place is the share of the passage's words, weighted by their rarity,
that stand where they belong.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. Nothing is shuffled but
one count a word of the index; the work stays in the document's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rare words under which a passage is posted, and how many of them must agree on where it begins (all, if it has fewer).
RARE, AGREE = 6, 3

#: (label, passage): phrases that are sought as a whole.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: (label, passage, key phrases). Notices as their licenses give them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote products derived from this software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("gpl-2", "the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl-3", "the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3 of the license")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international license",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international license",)),
)
PASSAGES = (*((label, text, (text,)) for label, text in BASE), *NOTICES)


def words(text: Column) -> Column:
    """The words of ``text``, none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def keyed(passages: Sequence[tuple[str, str, Sequence[str]]]) -> list[tuple[int, str, int, str, bool]]:
    """(number, label, place, word, whether a key phrase covers it) of every word of the passages."""
    out = []
    for t, (label, text, phrases) in enumerate(passages):
        own, keys = text.split(), set()
        for phrase in (p.split() for p in phrases):
            at = next((i for i in range(len(own)) if own[i : i + len(phrase)] == phrase), None)
            if at is None:
                raise ValueError(f"{' '.join(phrase)!r} is not in the passage {text!r}")
            keys |= set(range(at, at + len(phrase)))
        out += [(t, label, q, w, q in keys) for q, w in enumerate(own)]
    return out


def weights(listed: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Rarity of each word of the index in hundredths, at least 1, from its document frequency over all rows of ``listed(words)``."""
    own = F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))
    # the marker null counts the rows themselves
    seen = listed.select(F.explode(F.concat(own, F.array(F.lit(None).cast("string")))).alias("w"))
    count = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = count.pop(None, 0)
    return {w: 1 + floor(100 * log((rows + 1) / (count.get(w, 0) + 1))) for w in vocabulary}


def _text(w: str) -> str:
    return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lists(kind: str, items: Sequence[Sequence[str]]) -> str:
    return f"array({', '.join(f'cast(array({", ".join(x)}) AS ARRAY<{kind}>)' for x in items)})"


def scan(docs: DataFrame, passages: Sequence[tuple[str, str, Sequence[str]]] = PASSAGES) -> DataFrame:
    """``docs`` with n_words and places, an array of (start, passage, label, share) by start and passage.

    ``passages`` are (label, words, key phrases) of the index. A start counts words from 0 and is negative where
    a passage's first words are cut off; share is between 0 and 1. Null and empty texts have no words and no
    places. Repeated rows stay; very long texts are scanned whole, in time that grows with their words. An empty
    table stays empty. Columns of ``docs`` with the names of the added ones are replaced, all others pass through.
    """
    size, index = len(passages), keyed(passages)
    vocabulary = sorted({w for *_, w, _ in index})
    listed = docs.select(words(F.col("text")).alias("words"))
    weight = weights(listed, vocabulary)
    entry, posting = "STRUCT<q: INT, w: STRING>", "STRUCT<t: INT, q: INT>"
    rare, keys, every, post = [], [], [], {}
    for t in range(size):
        own = [(q, w, key) for n, _, q, w, key in index if n == t]
        place = {w: q for q, w, _ in reversed(own)}
        chosen = sorted(sorted(place, key=lambda w: (-weight[w], w))[:RARE], key=place.get)
        rare.append([f"named_struct('q', {place[w]}, 'w', {_text(w)})" for w in chosen])
        keys.append([f"named_struct('q', {q}, 'w', {_text(w)})" for q, w, key in own if key])
        every.append([f"named_struct('q', {q}, 'w', {_text(w)}, 'n', {weight[w]}L)" for q, w, _ in own])
        for w in chosen:
            post.setdefault(w, []).append(f"named_struct('t', {t}, 'q', {place[w]})")
    lookup = f"map({', '.join(f'{_text(w)}, array({", ".join(x)})' for w, x in post.items())})"
    agreed = f"array({', '.join(str(min(AGREE, len(x))) for x in rare)})"
    totals = f"array({', '.join(f'{sum(weight[w] for n, _, _, w, _ in index if n == t)}L' for t in range(size))})"
    labels = f"array({', '.join(_text(label) for label, *_ in passages)})"
    weighted = "STRUCT<q: INT, w: STRING, n: BIGINT>"

    whole, unpack = packed(docs, "text")
    d = whole.withColumn("words", words(F.col("text")))
    d = d.withColumn("hits", F.expr(f"CASE WHEN size(words) > 0 THEN filter(sequence(0, size(words) - 1), i -> words[i] IN ({', '.join(map(_text, post))})) ELSE cast(array() AS ARRAY<INT>) END"))
    # one number for a passage and where it begins: distinct numbers are told apart by hash
    d = d.withColumn("begins", F.expr(f"array_distinct(flatten(transform(hits, p -> transform({lookup}[words[p]], e -> cast(p - e.q AS BIGINT) * {size} + e.t))))"))
    at, t = f"cast(floor(x / {size}D) AS INT)", f"cast(pmod(x, {size}L) AS INT)"
    stands = lambda e: f"get(words, {at} + {e}.q) <=> {e}.w"
    d = d.withColumn("found", F.expr(f"filter(begins, x -> size(filter({_lists(entry, rare)}[{t}], e -> {stands('e')})) >= {agreed}[{t}] AND forall({_lists(entry, keys)}[{t}], e -> {stands('e')}))"))
    share = f"aggregate(filter({_lists(weighted, every)}[{t}], e -> {stands('e')}), 0L, (n, e) -> n + e.n) / cast({totals}[{t}] AS DOUBLE)"
    d = d.withColumn("places", F.expr(f"array_sort(transform(found, x -> named_struct('start', {at}, 'passage', {t}, 'label', {labels}[{t}], 'share', {share})))"))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    return unpack(d, "n_words", "places")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = f"filter(places, x -> x.passage < {len(BASE)})"
    names = lambda of: f"array_join(array_sort(array_distinct(transform({of}, x -> x.label))), ',')"
    return found.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) AS BIGINT)").alias("n_base"),
        F.expr(f"cast(array_min(transform({base}, x -> x.start)) AS BIGINT)").alias("first_word"),
        F.expr(f"cast(array_max(transform({base}, x -> x.start)) AS BIGINT)").alias("last_word"),
        F.expr(names(base)).alias("base_labels"),
        F.expr(names("places")).alias("labels"),
        F.expr("coalesce(array_max(transform(places, x -> x.share)), 0D)").alias("score"),
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
i(t, label, q, w, key) AS (VALUES {", ".join(f"({t}, '{label}', {q}, '{w}', {key})" for t, label, q, w, key in keyed(PASSAGES))}),
k AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM d),
f AS (SELECT v.w, 1 + floor(100 * ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT k.r) + 1)))::BIGINT AS n FROM (SELECT DISTINCT w FROM i) v LEFT JOIN k USING (w) GROUP BY v.w),
o AS (SELECT i.*, f.n, row_number() OVER (PARTITION BY t, i.w ORDER BY q) AS nth FROM i JOIN f USING (w)),
x AS (SELECT t, label, q, w, key, n, nth = 1 AND dense_rank() OVER (PARTITION BY t ORDER BY n DESC, w) <= {RARE} AS rare FROM o),
g AS (SELECT t, label, sum(n) AS total, count(*) FILTER (key) AS keys, least({AGREE}, count(*) FILTER (rare)) AS agreed FROM x GROUP BY ALL),
a AS (SELECT k.r, x.t, k.p - x.q AS s, sum(x.n) AS n, count(*) FILTER (key) AS keys, count(*) FILTER (rare) AS rare FROM k JOIN x USING (w) GROUP BY ALL),
m AS (SELECT a.r, a.t, g.label, a.s, a.n::DOUBLE / g.total::DOUBLE AS share, a.t < {len(BASE)} AS base FROM a JOIN g USING (t) WHERE a.keys = g.keys AND a.rare >= g.agreed)
SELECT d.doc_id, len(any_value(d.words))::BIGINT AS n_words, count(*) FILTER (m.base) AS n_base, min(m.s) FILTER (m.base) AS first_word, max(m.s) FILTER (m.base) AS last_word,
       coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label) FILTER (m.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label), '') AS labels, coalesce(max(m.share), 0) AS score
FROM d LEFT JOIN m USING (r) GROUP BY d.r, d.doc_id
"""
