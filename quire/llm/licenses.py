"""Licence scans: Dice coefficient of word bigrams between normalised passages and templates. DataFrame functions only.

A text is lowered and all but ASCII letters and digits become spaces; its passages are its lines, and its paragraphs of
more than one line. A passage and a template with a and b different word bigrams can reach Dice t only where
t / (2 - t) <= a / b <= (2 - t) / t, and where they share t * b / (2 - t) bigrams or more: other templates are not
compared. A text in which no template's telling words occur (words in so many of its bigrams that without them too few
could be shared) is settled by looking for those words alone. All work is within the row: nothing is shuffled, and a hot
licence line is a row's own matter.

Defined results: null and empty texts, and passages of fewer than two words, match nothing; ties go to the template
that comes first by name; null doc_ids and repeated rows are rows like others; an empty table gives an empty result;
whole texts of any length are scanned; further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_NOTICES = "array<struct<dice: double, place: int, licence: string>>"

# Words too common to tell anything, in lower case.
COMMON = frozenset("a an and any are as at be by for from in is it may not of on or that the this to under was with you your".split())
# Notices by which licences are granted, as their publishers word them, by SPDX name.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def bigrams(text: str) -> list[str]:
    """A template's different word bigrams, sorted."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def listed(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(name, bigrams) of every template that has any, by name."""
    return [(name, g) for name in sorted(templates) for text in templates[name] if (g := bigrams(text))]


def size_bounds(threshold: float) -> tuple[float, float]:
    """The ratios of sizes that can reach the threshold, widened by more than rounding may take off."""
    return threshold / (2 - threshold) * (1 - 1e-9), (2 - threshold) / threshold * (1 + 1e-9)


def telling(grams: list[str], threshold: float) -> list[str]:
    """Long and uncommon words of a template; a passage with none of them shares too few bigrams to reach the threshold."""
    least, out = threshold / (2 - threshold) * len(grams) * (1 - 1e-9), []
    left = [g.split() for g in grams]
    for word in sorted({w for g in left for w in g}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) < least:
            break
        if any(word in g for g in left):
            out.append(word)
            left = [g for g in left if word not in g]
    return out


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\n]+", " ")


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, notices) of every row: an array of (dice, place, licence), one for each passage that matches."""
    known = listed(TEMPLATES if templates is None else templates)
    low, high = size_bounds(threshold)
    sizes = [len(g) for _, g in known]
    table = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for i, (_, g) in enumerate(known)])
    names, every = F.array(*[F.lit(n) for n, _ in known]), F.array(*map(F.lit, sorted({x for _, g in known for x in g})))
    words = sorted({w for _, g in known for w in telling(g, threshold)})
    # Steps of their own, so that the normalised text is made once for all that looks at it.
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("norm"))
    flat = lowered.withColumn("flat", F.concat(F.lit(" "), F.translate("norm", "\n", " "), F.lit(" ")))
    told = F.lit(False)
    for w in words:
        told = told | F.contains("flat", F.lit(f" {w} "))
    paragraphs = F.filter(F.split("norm", "\\n ?(?:\\n ?)+"), lambda p: F.trim(p).contains("\n"))
    passages = F.concat(F.split("norm", "\n"), F.transform(paragraphs, lambda p: F.translate(p, "\n", " ")))
    split = F.transform(passages, lambda p: F.split(F.trim(F.regexp_replace(p, "  +", " ")), " "))
    # More words than bigrams could allow are fine: words repeat; fewer are not.
    enough = F.filter(split, lambda w: F.size(w) > F.lit(min(sizes) * low))
    grams = F.transform(enough, lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    maybe = F.filter(grams, lambda g: (F.size(g) >= F.lit(min(sizes) * low)) & (F.size(g) <= F.lit(max(sizes) * high)) & F.arrays_overlap(g, every))

    def best(g: Column) -> Column:
        fit = F.filter(table, lambda t: (F.size(g) >= t["n"] * low) & (F.size(g) <= t["n"] * high))
        return F.array_max(F.transform(fit, lambda t: F.struct((F.size(F.array_intersect(g, t["grams"])) * 2 / (F.size(g) + t["n"])).alias("dice"), t["place"].alias("place"))))

    found = F.filter(F.transform(maybe, best), lambda b: b["dice"] >= threshold)
    named = F.transform(found, lambda b: F.struct(b["dice"].alias("dice"), b["place"].alias("place"), F.element_at(names, 1 - b["place"]).alias("licence")))
    return flat.select("doc_id", F.when(told, named).otherwise(F.array().cast(_NOTICES)).alias("notices"))


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_notices, licences, best_licence, best_dice): names sorted and comma-joined; nulls where none."""
    top = F.array_max("notices")
    licences = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda b: b["licence"]))), ",")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), licences.alias("licences"), top["licence"].alias("best_licence"), top["dice"].alias("best_dice"))


def summary_sql(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB."""
    low, high = size_bounds(threshold)
    rows = ", ".join(f"({-i}, '{name}', [{', '.join(repr(x) for x in g)}])" for i, (name, g) in enumerate(listed(TEMPLATES if templates is None else templates)))
    return f"""
WITH template(place, licence, grams) AS (VALUES {rows}),
lowered AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
passage AS (
  SELECT r, unnest(string_split(t, chr(10))) AS p FROM lowered
  UNION ALL
  SELECT r, translate(p, chr(10), ' ') AS p FROM (SELECT r, unnest(regexp_split_to_array(t, '\\n ?(?:\\n ?)+')) AS p FROM lowered) WHERE contains(trim(p), chr(10))
),
worded AS (SELECT row_number() OVER () AS k, r, string_split(trim(regexp_replace(p, '  +', ' ', 'g')), ' ') AS w FROM passage),
grammed AS (SELECT k, r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) >= 2),
scored AS (
  SELECT k, r, place, licence, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grammed, template WHERE len(g) BETWEEN len(grams) * {low} AND len(grams) * {high}
),
best AS (SELECT k, r, max(struct_pack(dice := dice, place := place, licence := licence)) AS b FROM scored WHERE dice >= {threshold} GROUP BY k, r),
found AS (
  SELECT r, count(*) AS n, array_to_string(list_sort(list(DISTINCT b.licence)), ',') AS licences, max(b) AS top FROM best GROUP BY r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(licences, '') AS licences, top.licence AS best_licence, top.dice AS best_dice
FROM lowered LEFT JOIN found USING (r)"""
