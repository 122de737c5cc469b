"""License scans: key phrases, and license texts found by their rarest words at fitting positions. DataFrame operations alone.

The index is that of the templates: of each word, the templates and positions that have it. One pass counts the documents that hold each
word of the vocabulary; the scan then happens within a row, without row identity, shuffle or join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_of

# The base phrases with their labels, in the contract's order.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public license texts or passages of them in words as scanned, and the key phrases that each must have.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("with or without fee is hereby granted",),
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice", ("redistribution and use in source and binary forms",)),
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    "cc-license": ("this work is licensed under the creative commons attribution international license to view a copy of this license visit", ("licensed under", "creative commons")),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
}
#: Parts of words one of which stands in every base phrase and in one key phrase at least of every template.
MARKS = ("licens", " cc by ", " rights reserved ", " hereby granted ", "redistribution and use", " waived all copyright ")
#: Of each template's words that a file holds, so many with the highest inverse document frequency are looked up; so many of them must agree
#: on an offset.
RAREST, AGREE = 8, 2
Templates = dict[str, tuple[str, tuple[str, ...]]]

#: Characters that end a word once A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(text: Column) -> Column:
    """The words with one blank between, before and after; a single blank if there are none.

    All letters are lower-cased, which is quicker than A-Z alone: it moves no border of a word, and of the letters beyond ASCII only the
    Kelvin sign becomes one within (a k, which no base phrase has).
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), _GAP, " ")


def vocabulary(templates: Templates) -> list[str]:
    return sorted({w for text, _ in templates.values() for w in text.split()})


def document_frequencies(normal: DataFrame, words: list[str]) -> dict[str, int]:
    """Documents that hold each of the words, counted over all rows; one number a word comes to the driver."""
    known = F.array(*[F.lit(w) for w in words])
    found = normal.select(F.explode(F.array_intersect(F.split("normal", " "), known)).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in found}


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _has(phrase: str) -> Column:
    return F.contains("normal", F.lit(f" {phrase} "))


def _must(keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in keys:
        out = out & _has(p)
    return out


def _places(text: str) -> Column:
    """Word -> its places in the template."""
    words = text.split()
    return F.create_map(*[x for w in sorted(set(words)) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])


def _offsets(text: str, words: Column) -> Column:
    """Places in the file of the words (an array as long as the file, null where a word does not count) less those in the template, sorted."""
    places = _places(text)
    return F.array_sort(F.flatten(F.filter(F.transform(words, lambda v, p: F.transform(F.try_element_at(places, v), lambda q: p - q)), lambda x: x.isNotNull())))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value worked out once; a column that a lambda names may else be worked out for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(o: Column) -> Column:
    """Where runs of equal offsets start."""
    return F.filter(F.transform(o, lambda x, k: F.when((k == 0) | (F.get(o, F.greatest(k - 1, F.lit(0))) != x), k)), lambda k: k.isNotNull())


def _runs(o: Column) -> Column:
    """The offsets with the number of words that agree on each."""
    return _let(_starts(o), lambda s: F.transform(s, lambda k, i: F.struct(F.get(o, k).alias("at"), (F.coalesce(F.get(s, i + 1), F.size(o)) - k).alias("votes"))))


def _share(text: str, words: Column, ranked: list[str]) -> Column:
    """The greatest share of the template's words at an offset on which enough of the rarest words agree; null without such an offset."""
    # the intersection keeps the order of its first array: the rarest come first
    rarest = F.slice(F.array_intersect(F.array(*[F.lit(w) for w in ranked]), words), 1, RAREST)
    told = _let(rarest, lambda r: _offsets(text, F.transform(words, lambda v: F.when(F.array_contains(r, v), v))))
    agreed = _let(told, lambda o: F.transform(F.filter(_runs(o), lambda x: x["votes"] >= AGREE), lambda x: x["at"]))
    votes = lambda at: _let(_offsets(text, words), lambda a: F.array_max(F.transform(F.filter(_runs(a), lambda x: F.array_contains(at, x["at"])), lambda x: x["votes"])))
    return _let(agreed, lambda at: F.when(F.size(at) > 0, votes(at))) / F.lit(float(len(text.split())))


def scan_licenses(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those of the phrases whose words stand consecutively. For the method, a file that has a template's key phrases is
    looked up by the RAREST of that template's words that it holds, rarest by the documents that hold them: their places less their places
    in the template give offsets, and those on which AGREE of them meet are compared with the whole template. So what else the file holds
    takes no look-up away. score is the greatest share of a template's words found at such an offset; a base phrase is found whole, so its
    score is 1. Words of equal frequency go by the word. A null text has no words; words repeat and texts grow without bound on either, a
    text being one row's array of words where key phrases stand; rows are independent, so repeated ones and an empty table give what they
    hold. Other columns are ignored, whatever their names.
    """
    source = pick(docs, "doc_id", "text").select("doc_id", normal_text(text_of()).alias("normal"))
    frequency = document_frequencies(source, vocabulary(templates))
    # a text without any of these marks holds no phrase, so that one look decides for most texts
    marks = MARKS if templates is TEMPLATES else [f" {p} " for p in (*[p for p, _ in PHRASES], *[keys[0] for _, keys in templates.values()])]
    gate = F.lit(False)
    for mark in marks:
        gate = gate | F.contains("normal", F.lit(mark))
    source = source.select("doc_id", "normal", (_blanks(F.col("normal")) - 1).cast("long").alias("n_words"), gate.alias("gate"))
    source = source.select("*", *[(F.col("gate") & _has(p)).alias(f"h{i}") for i, (p, _) in enumerate(PHRASES)], *[F.when(F.col("gate"), _must(keys)).otherwise(False).alias(f"m{i}") for i, (_, keys) in enumerate(templates.values())])
    n = [F.when(F.col(f"h{i}"), F.regexp_count("normal", F.lit(f" {p}(?= )"))).otherwise(0).alias(f"n{i}") for i, (p, _) in enumerate(PHRASES)]
    first = [F.when(F.col(f"h{i}"), _blanks(F.substring("normal", F.lit(1), F.instr("normal", f" {p} "))) - 1).alias(f"f{i}") for i, (p, _) in enumerate(PHRASES)]
    # what follows the last place has no further match, so it is counted from the end
    last = [F.when(F.col(f"h{i}"), F.col("n_words") - _blanks(F.substring_index("normal", f" {p} ", -1)) - len(p.split())).alias(f"l{i}") for i, (p, _) in enumerate(PHRASES)]
    maybe = F.lit(False)
    for i in range(len(templates)):
        maybe = maybe | F.col(f"m{i}")
    musts = [f"m{i}" for i in range(len(templates))]
    source = source.select("doc_id", "n_words", *musts, *n, *first, *last, F.when(maybe, F.split(F.trim("normal"), " ")).alias("words"))
    counts = [f"{c}{i}" for c in "nfl" for i in range(len(PHRASES))]

    def share(text: str) -> Column:
        ranked = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        return _let(F.col("words"), lambda words: _share(text, words, ranked))

    shares = [F.when(F.col(f"m{i}"), share(text)).alias(f"t{i}") for i, (text, _) in enumerate(templates.values())]
    source = source.select("doc_id", "n_words", *counts, *shares)
    count = sum((F.col(f"n{i}") for i in range(1, len(PHRASES))), F.col("n0"))
    base = F.filter(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    more = F.filter(F.array(*[F.when(F.col(f"t{i}").isNotNull(), F.lit(t)) for i, t in enumerate(templates)]), lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.greatest(*[F.col(f"t{i}") for i in range(len(templates))]), F.lit(0.0))
    return source.select(
        "doc_id", "n_words", count.cast("long").alias("n_base"),
        F.least(*[F.col(f"f{i}") for i in range(len(PHRASES))]).cast("long").alias("first_word"),
        F.greatest(*[F.col(f"l{i}") for i in range(len(PHRASES))]).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(count > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def scan_sql() -> str:
    """The same as SQL over a view of documents."""
    has = lambda p: f"contains(normal, ' {p} ')"
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    n = [f"CASE WHEN {has(p)} THEN len(string_split(replace(normal, ' ', '  '), ' {p.replace(' ', '  ')} ')) - 1 ELSE 0 END AS n{i}" for i, (p, _) in enumerate(PHRASES)]
    first = [f"CASE WHEN {has(p)} THEN {blanks(f"substr(normal, 1, instr(normal, ' {p} '))")} - 1 END AS f{i}" for i, (p, _) in enumerate(PHRASES)]
    last = [f"CASE WHEN {has(p)} THEN {blanks('normal')} - {blanks(f"reverse(substr(reverse(normal), 1, instr(reverse(normal), ' {p[::-1]} ') - 1))")} - {len(p.split()) + 1} END AS l{i}" for i, (p, _) in enumerate(PHRASES)]
    maybe = " OR ".join(has(k[0]) for _, k in TEMPLATES.values())
    offsets, votes, shares = [], [], []
    for i, (text, keys) in enumerate(TEMPLATES.values()):
        w = text.split()
        offsets.append(f"""CASE WHEN words IS NOT NULL AND {" AND ".join(has(k) for k in keys)} THEN flatten(list_transform(list_filter(by_rank, lambda w: list_contains({lists(w)}, w) AND list_contains(words, w))[1:{RAREST}],
          lambda w: flatten(list_transform(list_filter(range(1, len(words) + 1), lambda p: words[p] = w), lambda p: list_transform(list_filter(range({len(w)}), lambda q: {lists(w)}[q + 1] = w), lambda q: p - 1 - q))))) END AS o{i}""")
        votes.append(f"list_filter(list_distinct(o{i}), lambda d: len(list_filter(o{i}, lambda x: x = d)) >= {AGREE}) AS v{i}")
        shares.append(f"list_max(list_transform(v{i}, lambda d: len(list_filter(range({len(w)}), lambda i: d + i >= 0 AND coalesce(words[d + i + 1] = {lists(w)}[i + 1], false))))) / {float(len(w))} AS t{i}")
    base = ", ".join(f"CASE WHEN n{i} > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))
    more = ", ".join(f"CASE WHEN t{i} IS NOT NULL THEN '{t}' END" for i, t in enumerate(TEMPLATES))
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda x: x IS NOT NULL))), ','), '')"
    count = " + ".join(f"n{i}" for i in range(len(PHRASES)))
    return f"""
WITH base AS (SELECT doc_id, regexp_replace(' ' || translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') || ' ', '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS normal FROM documents),
vocabulary AS (SELECT unnest({lists(vocabulary(TEMPLATES))}) AS word),
frequency AS (SELECT word, count(d.w) AS df FROM vocabulary LEFT JOIN (SELECT unnest(list_distinct(string_split(normal, ' '))) AS w FROM base) d ON word = w GROUP BY word),
ranked AS (SELECT list(word ORDER BY df, word) AS by_rank FROM frequency),
found AS (SELECT doc_id, normal, {blanks("normal")} - 1 AS n_words, {", ".join(n + first + last)}, CASE WHEN {maybe} THEN string_split(trim(normal), ' ') END AS words FROM base),
offsets AS (SELECT *, {", ".join(offsets)} FROM found, ranked),
votes AS (SELECT *, {", ".join(votes)} FROM offsets),
shares AS (SELECT *, {", ".join(shares)} FROM votes)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST({count} AS BIGINT) AS n_base, CAST(least({", ".join(f"f{i}" for i in range(len(PHRASES)))}) AS BIGINT) AS first_word,
  CAST(greatest({", ".join(f"l{i}" for i in range(len(PHRASES)))}) AS BIGINT) AS last_word, {joined(base)} AS base_labels, {joined(base + ", " + more)} AS labels,
  CASE WHEN {count} > 0 THEN 1.0::DOUBLE ELSE coalesce(greatest({", ".join(f"t{i}" for i in range(len(TEMPLATES)))}), 0)::DOUBLE END AS score
FROM shares
"""
