"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units are the lines of a text, the whole text where it has several lines, and
windows of words for notices wrapped over lines or inside longer ones. A unit
is lower-cased, what is neither letter nor digit parts words, and its distinct
bigrams, as 64-bit hashes, are compared with those of each template. At a
threshold t, sets of a and b bigrams can only reach it if a t / (2 - t) <= b
and b t / (2 - t) <= a, and then share at least b t / (2 - t). So a document
is passed over unless it has, for some template, a word of each of up to three
covers of such a share and one of the fewest bigrams that any such share must
hold; and of the rest only templates of which the document has that share are
tried. All of it happens inside the row: no shuffle, the templates are literals.

Windows start and end at bigrams of the template and are at most (2 - t) / t
times as long as it; of overlapping ones the best is given, and none that
touches a line that matches, or lies in a text that matches as a whole. Long
licences stand in the table with the passage that opens them.

Defined cases: null and empty texts and units of fewer than two words match
nothing; of equally good templates the first by name is given; a line that
occurs several times is found at each place; rows that repeat a doc_id are
scanned each for itself, a null doc_id is passed through; a very long text is
one row, and beyond the words of covers only its matching templates' windows
are looked at; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole

THRESHOLD = 0.8
#: Words that tell little; a document is not looked at for one of them if others do.
COMMON = set("a above all and any at be by can copy for in into is it may not of on or that the this to under was with you".split())

#: Public licence texts and the notices that stand for them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "CC-BY-4.0-text": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-SA-4.0-text": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


#: Words that the templates of a table may have in all: they are part of the plan.
MOST_WORDS = 60_000


def templates_of(table: DataFrame, most: int = MOST_WORDS) -> dict[str, str]:
    """Templates of a table (name, text), notices or full texts, whose size is checked before it is read; of one name the least text stays."""
    known = table.where("name is not null and text is not null")
    words = known.agg(F.sum(F.size(_words(F.col("text"))))).first()[0] or 0
    if words > most:
        raise ValueError(f"the templates have {words} words, more than {most}")
    return {r["name"]: r["text"] for r in known.groupBy("name").agg(F.min("text").alias("text")).collect()}


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct bigrams of each template, by name."""
    out = {}
    for name, text in sorted(templates.items()):
        words = re.findall("[a-z0-9]+", text.lower())
        out[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    return out


def _split(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ", -1)


def _words(text: Column) -> Column:
    return F.filter(_split(text), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Hashes of the bigrams of at least two words, in order."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))


def _once(value: Column) -> Column:
    """A generator of one row: what stands above it reads the value and never computes it again."""
    return F.explode(F.array(value))


def _cover(bigrams: list[str], least: int, used: tuple[str, ...] = ()) -> list[str]:
    """Words, none of ``used``, of which any ``least`` of the bigrams hold one; few, and no common or short ones if it can be done."""
    left, out = [set(b.split(" ")) for b in bigrams], []
    while len(left) >= least and (words := sorted({w for b in left for w in b} - {*used})):
        telling = lambda w: w not in COMMON and not w.isdigit() and len(w) > 2
        out.append(max(words, key=lambda w: (telling(w), sum(w in b for b in left))))
        left = [b for b in left if out[-1] not in b]
    return out if len(left) < least else []


def _some_pairs(bigrams: list[str], least: int) -> list[str]:
    """As few bigrams as any ``least`` of all must meet, those of telling words."""
    telling = lambda b: sum(len(w) * (w not in COMMON and not w.isdigit()) for w in b.split(" "))
    return sorted(bigrams, key=telling, reverse=True)[: len(bigrams) - least + 1]


def _may_hold(lowered: Column, bigrams: list[str], least: int) -> Column:
    """Whether a lower-cased text has a word of each of up to three disjoint covers, and one of the bigrams to be met."""
    out, used = F.lit(True), ()
    for number in range(3):
        words = _cover(bigrams, least, used)
        if not words or number and any(w in COMMON or w.isdigit() for w in words):
            break
        out, used = out & reduce(or_, (F.contains(lowered, F.lit(w)) for w in words)), (*used, *words)
    pattern = "|".join(b.replace(" ", r"[^\p{L}\p{N}]+") for b in _some_pairs(bigrams, least))
    return out & lowered.rlike(pattern)


def licence_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, licence, dice) for each unit that matches: the line from 0 on (for a window, in which it begins), -1 the whole text."""
    known = template_bigrams(templates)
    reach = threshold / (2 - threshold)
    least = {name: math.ceil(len(b) * reach - 1e-9) for name, b in known.items()}
    hashed = {name: F.array(*(F.xxhash64(*map(F.lit, b.split(" "))) for b in bigrams)) for name, bigrams in known.items()}
    some = docs.select("doc_id", _once(F.lower(whole(F.col("text")))).alias("text"))
    some = some.where(reduce(or_, (_may_hold(F.col("text"), b, least[name]) for name, b in known.items())))
    some = some.select("doc_id", _once(F.transform(F.split("text", "\n", -1), _words)).alias("lines"))
    owners = F.flatten(F.transform("lines", lambda words, k: F.array_repeat(k, F.size(words))))
    some = some.select("doc_id", "lines", _once(F.flatten("lines")).alias("words"), owners.alias("owners"))
    some = some.where(F.size("words") > 1).select("doc_id", "lines", "owners", _once(_pairs(F.col("words"))).alias("pairs"))
    kinds = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(least[n]).alias("least"), F.lit(len(re.findall("[a-z0-9]+", templates[n].lower())) - 1).alias("length"), hashed[n].alias("template")) for n in known))
    some = some.select("*", _once(F.filter(kinds, lambda k: F.size(F.array_intersect("pairs", k["template"])) >= k["least"])).alias("kinds"))
    some = some.where(F.size("kinds") > 0)
    n = F.size("pairs")
    dice = lambda pairs, t: 2 * F.size(F.array_intersect(pairs, t)) / (F.size(F.array_distinct(pairs)) + F.size(t))

    # Lines and the whole text: the best template of each.
    def scored(pairs: Column, unit: Column) -> Column:
        fits = F.transform("kinds", lambda k: F.named_struct(F.lit("loss"), -dice(pairs, k["template"]), F.lit("licence"), k["licence"], F.lit("unit"), unit.cast("long")))
        return F.array_min(F.filter(fits, lambda x: -x["loss"] >= threshold))

    by_line = F.transform("lines", lambda words, i: F.when(F.size(words) > 1, scored(_pairs(words), i)))
    some = some.select("*", _once(F.array_compact(by_line)).alias("in_lines"), _once(F.when(F.size("lines") > 1, scored(F.col("pairs"), F.lit(-1)))).alias("in_all"))

    # Windows, where the text as a whole is no match.
    def windows(k: Column) -> Column:
        span = F.floor(k["length"] / reach + 1e-9).cast("int")
        here = lambda i: F.array_contains(k["template"], F.get("pairs", i))
        enough = lambda i: F.size(F.array_intersect(F.slice("pairs", i + 1, span), k["template"])) >= k["least"]
        starts = F.filter(F.filter(F.sequence(F.lit(0), n - 1), here), enough)
        ends = lambda i: F.filter(F.sequence(i, F.least(i + span, n) - 1), lambda j: (j - i + 1 >= k["least"]) & here(j))
        window = lambda i, j: F.named_struct(F.lit("loss"), -dice(F.slice("pairs", i + 1, j - i + 1), k["template"]), F.lit("licence"), k["licence"], F.lit("first"), i, F.lit("last"), j)
        return F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: window(i, j))))

    found = F.filter(F.flatten(F.transform("kinds", windows)), lambda w: -w["loss"] >= threshold)
    matched_all = F.col("in_all").isNotNull() | ((F.size("lines") == 1) & (F.size("in_lines") > 0))
    some = some.select("doc_id", "owners", "in_lines", "in_all", _once(F.when(~matched_all, F.array_sort(found))).alias("found"))
    line = lambda i: F.get("owners", i)
    free = F.filter("found", lambda w: ~F.exists("in_lines", lambda m: (m["unit"] >= line(w["first"])) & (m["unit"] <= line(w["last"] + 1))))
    some = some.select("doc_id", "owners", "in_lines", "in_all", _once(free).alias("free"))
    beside = lambda kept, w: F.forall(kept, lambda x: (x["last"] + 1 < w["first"]) | (w["last"] + 1 < x["first"]))
    best = F.aggregate("free", F.slice("free", 1, 0), lambda kept, w: F.when(beside(kept, w), F.concat(kept, F.array(w))).otherwise(kept))
    inside = F.transform(best, lambda w: F.named_struct(F.lit("loss"), w["loss"], F.lit("licence"), w["licence"], F.lit("unit"), line(w["first"]).cast("long")))
    results = F.concat("in_lines", F.array_compact(F.array("in_all")), F.coalesce(inside, F.slice("in_lines", 1, 0)))
    return some.select("doc_id", F.explode(results).alias("m")).select("doc_id", "m.unit", "m.licence", (-F.col("m.loss")).alias("dice"))


def oracle() -> str:
    """The scan as DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, b))}])" for n, b in template_bigrams(TEMPLATES).items())
    return rf"""
        with l as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        p as (
            select doc_id, unnest(lines) as part, generate_subscripts(lines, 1) - 1 as unit from l
            union all select doc_id, text, -1 from l where len(lines) > 1),
        w as (
            select doc_id, unit, string_split(trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') as words from p),
        b as (
            select doc_id, unit, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) as bigrams
            from w where len(words) > 1),
        t(licence, template) as (values {values}),
        d as (
            select doc_id, unit, licence,
                   2 * len(list_intersect(bigrams, template)) / (len(bigrams) + len(template)) as dice
            from b cross join t where len(bigrams) between {THRESHOLD / (2 - THRESHOLD)} * len(template) and len(template) / {THRESHOLD / (2 - THRESHOLD)})
        select doc_id, cast(unit as bigint) as unit, licence, dice from d where dice >= {THRESHOLD}
        qualify row_number() over (partition by doc_id, unit order by dice desc, licence) = 1
    """
