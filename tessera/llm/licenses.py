"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Only DataFrame functions run here. A text's words are shingled once. Windows as long as each template
start at every ``stride``-th word; a template of which a window holds the share ``CONTAINMENT`` has with
one of them a Jaccard similarity of at least :func:`least_similarity`, and the number of bands is set from
that floor so that they collide with a probability of ``COLLISION``. Each band is one minimum: collisions
are verified exactly, so that false ones cost a comparison only.

Most texts hold no notice. A match leaves out less than 1 - ``CONTAINMENT`` of a template's shingles; if
more of them than that hold one of its anchor words, every match holds an anchor. So texts without any
anchor are left out, and windows are made around anchors only, without losing a match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TEXT_KEYS, text_keys, text_or_empty

SHINGLE = 5
CONTAINMENT = 0.8
COLLISION = 0.999
WORD = r"[\p{L}\p{N}]+"
ANCHORS = ("license", "licensed", "licence", "copyright", "copyrights", "warranty", "warranties", "redistribution", "permission", "public")

# fixed values: wording of public licenses and of their usual notices
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "unlicense-dedication": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str]) -> list[str]:
    """Shingles of a template; one of fewer words than a shingle is one shingle."""
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def stride(words: int) -> int:
    return max(1, words // 8)


def least_similarity(words: int, containment: float = CONTAINMENT) -> float:
    """Jaccard similarity of a template of ``words`` words and the window nearest to a match of it."""
    n = max(1, words - SHINGLE + 1)
    held = math.ceil(containment * n - 1e-9) - stride(words) // 2
    return held / (2 * n - held)


def bands(lengths: list[int], containment: float = CONTAINMENT, collision: float = COLLISION) -> int:
    floor = min(least_similarity(n, containment) for n in lengths)
    return 1 if floor >= 1 else math.ceil(math.log(1 - collision) / math.log(1 - floor))


def anchors_of(words: list[str], containment: float = CONTAINMENT) -> set[str]:
    """Words of which more than 1 - ``containment`` of the shingles hold one: the usual ones first, then the longest."""
    grams, chosen = [set(s.split()) for s in dict.fromkeys(shingles_of(words))], set()
    for word in sorted(set(words), key=lambda w: (w not in ANCHORS, -len(w), w)):
        if sum(bool(g & chosen) for g in grams) > (1 - containment) * len(grams) + 1e-9:
            break
        chosen.add(word)
    return chosen


def _hashes(words: Column) -> Column:
    """The shingles of an array of words as longs; fewer words than a shingle are one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def _minima(hashes: Column, n: int) -> Column:
    """One minimum for each band. Shingles' hashes are random, so flipping fixed bits reorders them at random."""
    flips = [int.from_bytes(((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)).to_bytes(8, "little"), "little", signed=True) for i in range(n)]
    least = lambda flip: F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(flip))))
    return F.array(*map(least, flips))


def _table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(license, words, hashes)`` of the templates: as many rows as there are templates."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(len(words)).alias("words"), F.array(*map(F.lit, words)).alias("text")) for name, text in sorted(templates.items()) if (words := template_words(text))]
    return spark.range(1).select(F.explode(F.array(*[F.struct(r.alias("r")) for r in rows])).alias("x")).select("x.r.*").select("license", "words", F.array_distinct(_hashes(F.col("text"))).alias("hashes"))


def license_notices(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license, containment, first_word)``: templates of which a text holds ``containment`` or more.

    ``containment`` is the largest share of the template's shingles in a window, ``first_word`` the word
    (from 0) at which the first such window starts. Null and empty texts match nothing; rows of one doc_id
    and text count as one document, and unlike texts of one doc_id, or of none, each have rows of their own; further columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    words = {name: template_words(text) for name, text in templates.items()}
    lengths = sorted({len(w) for w in words.values() if w})
    count = bands(lengths, containment)
    anchors = sorted(set().union(*(anchors_of(w, containment) for w in words.values())))
    known = _table(spark, templates)

    own, text = ("doc_id", *TEXT_KEYS), F.lower(text_or_empty())
    some = docs.select("doc_id", *text_keys(), text.alias("text")).where(F.col("text").rlike("|".join(anchors)))
    split = some.select(*own, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    is_anchor = lambda x: x.isin(anchors)
    placed = split.select(*own, F.filter(F.transform("w", lambda x, i: F.when(is_anchor(x), i)), lambda i: i.isNotNull()).alias("at"), "w").where(F.size("at") > 0)
    hashed = placed.select(*own, "at", _hashes(F.col("w")).alias("h"))

    def windows(n: int) -> Column:
        step, wide = stride(n), stride(n) + n // 5
        shingles = max(1, n - SHINGLE + 1)
        low = lambda p: F.greatest(F.floor((p - n - step) / F.lit(step)) + 1, F.lit(0)).cast("int")
        starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(low(p), F.floor((p + step) / F.lit(step)).cast("int")))))
        inside = F.filter(F.transform(starts, lambda s: s * step), lambda s: s < F.size("h"))
        first = lambda s: F.greatest(s - wide, F.lit(0))
        return F.transform(
            inside,
            lambda s: F.struct(F.lit(n).alias("words"), s.alias("start"), F.slice("h", s + 1, shingles).alias("own"), F.slice("h", first(s) + 1, s + F.lit(shingles + wide) - first(s)).alias("near")),
        )

    spread = hashed.select(*own, F.explode(F.concat(*map(windows, lengths))).alias("x")).select(*own, "x.*")
    keyed = spread.select(*own, "words", "start", "near", F.posexplode(_minima(F.col("own"), count)).alias("band", "least"))
    template_bands = known.select("license", "words", "hashes", F.posexplode(_minima(F.col("hashes"), count)).alias("band", "least"))
    # as many rows as templates times bands, whatever the documents hold
    met = keyed.join(F.broadcast(template_bands), ["words", "band", "least"])
    share = F.size(F.array_intersect("near", "hashes")) / F.size("hashes")
    found = met.select(*own, "license", "start", share.alias("share")).where(F.col("share") >= containment - 1e-9)
    return found.groupBy(*own, "license").agg(F.max("share").alias("containment"), F.min("start").alias("first_word")).drop(*TEXT_KEYS)
