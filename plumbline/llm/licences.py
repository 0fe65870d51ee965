"""Licence scan: normalised text against templates by Dice over word bigrams.

Lines, sentences and the whole text of a document are compared with every
template whose size lets it reach the threshold, and so are runs of consecutive
atoms, the pieces between line and sentence ends: paragraphs, wrapped sentences
and runs of lines or of sentences are all such runs. All of it is array functions
on the row, so a scan shuffles nothing and runs no Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words too common to look a template up by.
COMMON = {"the", "of", "and", "or", "under", "to", "this", "is", "in", "a", "by", "for", "any", "all", "at", "you", "it", "may", "be", "with", "on"}

# Licence notices as their authors word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    """Bigrams with their number among equal ones, as segments have them."""
    words, seen, out = template_words(text), Counter(), []
    for pair in zip(words, words[1:]):
        seen[pair] += 1
        out.append(f"{pair[0]} {pair[1]} {seen[pair]}")
    return out


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """Bigram counts a segment must lie between to reach the threshold with ``size`` bigrams."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def whole_bounds(size: int, threshold: float) -> tuple[int, int]:
    """``size_bounds`` in whole bigrams, by the very comparison that scores make, so that none at the threshold is lost."""
    if not size:
        return 1, 0
    low, high = (round(b) for b in size_bounds(size, threshold))
    low = next(n for n in range(max(1, low - 2), size + 1) if 2.0 * n / (n + size) >= threshold)
    return low, next(n for n in range(high + 2, size - 1, -1) if 2.0 * size / (n + size) >= threshold)


def key_words(text: str, threshold: float) -> set[str]:
    """Words of which any matching segment has one.

    A match shares at least as many bigrams as ``whole_bounds`` has for the smallest
    segment, so it has one of any that are more than the rest. Those with the longest uncommon
    word are taken, for long words are rare, and of each its longest such word.
    """
    pairs = [b.split()[:2] for b in template_bigrams(text)]
    needed = whole_bounds(len(pairs), threshold)[0]
    telling = [max(p, key=lambda w: (w not in COMMON, len(w))) for p in pairs]
    telling.sort(key=lambda w: (w in COMMON, -len(w)))
    return set(telling[: len(pairs) - needed + 1])


def normal(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9.!?;\n]+", " ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(piece: Column) -> Column:
    return F.filter(F.split(F.translate(piece, ".!?;\n", "     "), " "), lambda w: w != "")


def segments(text: Column, pattern: str) -> Column:
    """Word lists of the lines, the sentences and the whole of a text that match ``pattern``."""
    plain = normal(text)
    pieces = F.concat(F.split(plain, "\n"), F.split(plain, "\n|[.!?;] "), F.array(plain))
    named = F.filter(F.array_distinct(pieces), lambda s: s.rlike(pattern))
    return F.transform(named, words_of)


def joined(text: Column, known: list[str], low: int, high: int, threshold: float) -> Column:
    """(first, last, words) of runs of two atoms or more that could reach the threshold.

    Of a run's bigrams ``threshold / (2 - threshold)`` must be ``known``, those of
    the templates. An atom at an end with known bigrams for less than half the
    threshold of its words only lowers a score, so the run without it, which is
    looked at too, stands for the longer one. ``first`` and ``last`` are atom numbers.
    """
    share = threshold / (2 - threshold) - 1e-9
    atoms = F.filter(F.transform(F.split(normal(text), "\n|[.!?;] "), words_of), lambda w: F.size(w) > 0)

    def counted(a: Column) -> Column:
        # Known bigrams that start in an atom, with the one that leads into the next.
        def one(w: Column, i: Column) -> Column:
            on = F.concat(w, F.coalesce(F.slice(F.get(a, i + 1), 1, 1), F.array().cast("array<string>")))
            hits = let(on, lambda x: F.when(F.size(x) > 1, F.size(F.filter(bigrams(x), lambda b: b.isin(known)))).otherwise(0))
            return F.struct(F.size(w).alias("n"), hits.alias("g"))

        return F.transform(a, one)

    def firm(c: Column) -> Column:
        return c["g"] >= c["n"] * (threshold / 2 - 1e-9)

    def from_(counts: Column, start: Column) -> Column:
        """Last atoms of the runs from ``start``."""
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("g"), F.lit(-1).alias("k"), F.array().cast("array<int>").alias("ends"))

        def grow(s: Column, c: Column) -> Column:
            n, g, k = s["n"] + c["n"], s["g"] + c["g"], s["k"] + 1
            good = (k > 0) & (n - 1 >= low) & (n - 1 <= high) & firm(c) & (g >= (n - 1) * share)
            return F.struct(n.alias("n"), g.alias("g"), k.alias("k"), F.when(good, F.concat(s["ends"], F.array(start + k))).otherwise(s["ends"]).alias("ends"))

        return F.aggregate(F.slice(counts, start + 1, F.lit(high + 1)), begin, grow, lambda s: s["ends"])

    def runs(a: Column, counts: Column) -> Column:
        starts = F.filter(F.transform(counts, lambda c, i: F.when(firm(c), i)), lambda i: i.isNotNull())
        ends = F.transform(starts, lambda i: F.transform(from_(counts, i), lambda j: F.struct(i.alias("first"), j.alias("last"))))
        return F.transform(
            F.flatten(ends),
            lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last"), F.flatten(F.slice(a, e["first"] + 1, e["last"] - e["first"] + 1)).alias("words")),
        )

    return let(atoms, lambda a: let(counted(a), lambda c: runs(a, c)))


def bigrams(words: Column) -> Column:
    """Bigrams of a word list of two words or more."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def numbered(pairs: Column) -> Column:
    """Bigrams with their number among equal ones."""
    same = lambda b, i: F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == b))
    return F.transform(pairs, lambda b, i: F.concat_ws(" ", b, same(b, i)))


def scan(
    docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with ``licences``: an array of (score, licence, words), best first.

    There is one entry for each distinct segment that reaches the threshold with a
    template, with its best template (the first name in the alphabet on a tie). Of
    runs of atoms that share one, only the best counts (then the first, then the
    shortest), and only if it scores above every line, sentence or text that lies
    within it or around it.
    Null and empty texts and texts without a match have an empty array; every row
    is scanned by itself, so repeated rows repeat. An existing column ``licences``
    is replaced.
    """
    sizes = [len(template_bigrams(t)) for _, t in templates]
    keys = sorted(set().union(*[key_words(t, threshold) for _, t in templates])) or [""]
    bounds = [whole_bounds(n, threshold) for n in sizes]
    could = F.array(*[F.lit(k) for k in keys])
    # Any match has one of the key words; a text or piece without them is not taken apart.
    pattern = "(?<![a-z0-9])(?:" + "|".join(keys) + ")(?![a-z0-9])"
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)

    def likely(words: Column) -> Column:
        n = F.size(words) - 1
        return (n >= low) & (n <= high) & F.arrays_overlap(words, could)

    table = F.array(
        *[
            F.struct(F.lit(name).alias("licence"), F.lit(n).alias("size"), F.lit(lo).alias("low"), F.lit(hi).alias("high"),
                     F.array(*[F.lit(b) for b in template_bigrams(text)]).alias("pairs"))
            for (name, text), n, (lo, hi) in zip(templates, sizes, bounds)
        ]
    )

    def best(own: Column) -> Column:
        n = F.size(own)
        fitting = F.filter(table, lambda t: (n >= t["low"]) & (n <= t["high"]))
        rated = F.transform(
            fitting, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(own, t["pairs"])) / (n + t["size"])).alias("rank"), t["licence"].alias("licence"))
        )
        return F.array_min(F.filter(rated, lambda r: r["rank"] <= -threshold))

    def rated(near: Column) -> Column:
        """(rank, licence, first, last, words) of the (first, last, words) that match."""
        step = F.transform(near, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["words"].alias("words"), bigrams(x["words"]).alias("pairs")))
        step = F.transform(step, lambda x: x.withField("pairs", numbered(x["pairs"])))
        step = F.transform(step, lambda x: F.struct(best(x["pairs"]).alias("b"), x["first"].alias("first"), x["last"].alias("last"), x["words"].alias("words")))
        return F.array_sort(
            F.transform(
                F.filter(step, lambda x: x["b"].isNotNull()),
                lambda x: F.struct(x["b"]["rank"].alias("rank"), x["b"]["licence"].alias("licence"), x["first"].alias("first"), x["last"].alias("last"), F.array_join(x["words"], " ").alias("words")),
            )
        )

    def apart(runs: Column) -> Column:
        """The best of runs that overlap."""
        none = F.array().cast("array<struct<rank:double,licence:string,first:int,last:int,words:string>>")
        meets = lambda x, y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])
        return F.aggregate(runs, none, lambda kept, x: F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.concat(kept, F.array(x))))

    def within(a: Column, b: Column) -> Column:
        return F.concat(F.lit(" "), b["words"], F.lit(" ")).contains(F.concat(F.lit(" "), a["words"], F.lit(" ")))

    docs = docs.drop("licences")
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = sorted({b.rsplit(" ", 1)[0] for _, t in templates for b in template_bigrams(t)}) or [""]
    # Each step names what the next one uses more than once.
    close = F.filter(segments(text, pattern), likely)
    close = F.transform(F.array_distinct(F.transform(close, lambda w: F.array_join(w, " "))), lambda s: F.split(s, " "))
    single = rated(F.transform(close, lambda w: F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), w.alias("words"))))
    runs = rated(joined(text, known, low, high, threshold))

    def together(alone: Column, runs: Column) -> Column:
        better = F.filter(runs, lambda x: ~F.exists(alone, lambda y: (y["rank"] <= x["rank"]) & (within(x, y) | within(y, x))))
        bare = lambda hits: F.transform(hits, lambda x: F.struct(x["rank"].alias("rank"), x["licence"].alias("licence"), x["words"].alias("words")))
        return F.array_sort(F.array_distinct(F.concat(bare(alone), bare(apart(better)))))

    hits = let(single, lambda alone: let(runs, lambda r: together(alone, r)))
    named = F.transform(hits, lambda x: F.struct((-x["rank"]).alias("score"), x["licence"].alias("licence"), x["words"].alias("words")))
    nothing = F.array().cast("array<struct<score:double,licence:string,words:string>>")
    has_key = F.translate(F.col(text_col), UPPER, LOWER).rlike(pattern)
    return docs.withColumn("licences", F.when(has_key, named).otherwise(nothing))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The query's rows in DuckDB."""
    rows = reduce(
        lambda a, b: f"{a}, {b}",
        [f"({i}, '{name}', {len(template_bigrams(t))}, '{' '.join(template_words(t))}')" for i, (name, t) in enumerate(templates)],
    )
    return f"""
    WITH templates(no, licence, size, body) AS (VALUES {rows}),
    template_pairs AS (
        SELECT no, w[i] || ' ' || w[i + 1] AS pair, count(*) AS n
        FROM (SELECT no, string_split(body, ' ') AS w FROM templates), LATERAL (SELECT unnest(range(1, len(w))) AS i)
        GROUP BY ALL
    ),
    plain AS (
        SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9.!?;\\n]+', ' ', 'g') AS p
        FROM documents
    ),
    pieces AS (
        SELECT DISTINCT doc_id, list_filter(string_split(translate(s, E'.!?;\\n', '     '), ' '), lambda x: x <> '') AS w
        FROM plain, LATERAL (SELECT unnest(string_split(p, E'\\n') || string_split_regex(p, '\\n|[.!?;] ') || [p]) AS s)
    ),
    sized AS (SELECT row_number() OVER () AS seg, doc_id, w, len(w) - 1 AS n FROM pieces
              WHERE len(w) >= 2 AND len(w) - 1 <= {max(size_bounds(len(template_bigrams(t)), threshold)[1] for _, t in templates)}),
    pairs AS (
        SELECT seg, w[i] || ' ' || w[i + 1] AS pair, count(*) AS n
        FROM sized, LATERAL (SELECT unnest(range(1, len(w))) AS i) GROUP BY ALL
    ),
    common AS (SELECT seg, no, sum(least(p.n, t.n)) AS c FROM pairs p JOIN template_pairs t USING (pair) GROUP BY ALL),
    scored AS (
        SELECT s.seg, s.doc_id, t.licence, 2.0::DOUBLE * c / (s.n + t.size) AS score
        FROM common JOIN sized s USING (seg) JOIN templates t USING (no)
        WHERE 2.0::DOUBLE * c / (s.n + t.size) >= {threshold}
    ),
    best AS (SELECT seg, doc_id, min((-score, licence)) AS b FROM scored GROUP BY ALL),
    found AS (SELECT doc_id, min(b) AS b, count(*) AS n FROM best GROUP BY ALL)
    SELECT d.doc_id, b[2] AS licence, coalesce(-b[1], 0.0)::DOUBLE AS score, coalesce(n, 0)::BIGINT AS n_segments
    FROM documents d LEFT JOIN found USING (doc_id)
    """
