"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment confirms them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices by license, as authors put them into texts, and the texts and headers that licenses ask to be copied.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
}


def templates_of(spark: SparkSession, notices: dict[str, str] = NOTICES) -> DataFrame:
    return spark.createDataFrame(sorted(notices.items()), "template_id string, template string")


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of `width` words, in order, repeats included; none for fewer words."""
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def minhash(shingles: Column, row: Column) -> Column:
    """The shingle that comes first in the row-th random order."""
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, row)))


def bands_for(words: int, stride: int, width: int, containment: float, chance: float) -> int:
    """Bands of one row that a window holding `containment` of a template's shingles meets with at least this chance."""
    n = words - width + 1
    shared = math.ceil(containment * n - 1e-9)
    jaccard = shared / (words + stride - width + 1 + n - shared)
    return 1 if jaccard >= 1 else math.ceil(math.log(1 - chance) / math.log(1 - jaccard))


def cover(sets: list[set[str]]) -> list[str]:
    """Few words of which every set has one, chosen greedily; long words first among equals."""
    left, chosen = list(sets), []
    while left:
        n = Counter(w for s in left for w in s)
        best = max(n, key=lambda w: (n[w] * len(w), w))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def scan(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = 5, containment: float = 0.8, chance: float = 0.9999, max_templates: int = 10_000,
) -> DataFrame:
    """(id, template_id, containment, first_word, windows): a row for each document and template of which a window holds enough.

    A template of m words is sought in windows of m + m // 4 words (one more than m at least), m // 4 apart, so that every place it can stand
    lies in one window; a text shorter than that is one window. Each length has as many MinHash bands of one row as make a match with the given containment collide with at least
    `chance`. Windows that collide with a template are checked: the share of the template's distinct `width`-word shingles in the window is
    returned, the largest over the windows that reach `containment`, with the number of such windows and the word (from 0) where the first
    starts.

    A window can only collide if it holds the first shingle of some template in some order; documents without any such shingle, and before that
    those without any word of a set that has one of each such shingle, are left out before windows are made. Neither loses a match. Templates are few: more than `max_templates`, or one with fewer than `width` words, is an error.
    Null and empty texts match nothing. Rows that repeat an id are one document, also those with a null id. Of windows with the same share the first counts.
    Texts of any length are searched whole. An empty table gives no rows. Other columns are ignored, whatever their names. Only DataFrame functions are used.
    """
    spark = docs.sparkSession
    t = templates.select("template_id", words_of(F.col("template")).alias("w")).select("template_id", F.size("w").alias("m"), F.array_distinct(shingles_of(F.col("w"), width)).alias("shingles"), "w")
    known = t.limit(max_templates + 1).collect()
    if len(known) > max_templates or any(r["m"] < width for r in known):
        raise ValueError(f"over {max_templates} templates, or one shorter than {width} words")
    schema = f"template_id {templates.schema['template_id'].dataType.simpleString()}, m int, shingles array<bigint>"
    word_lists = spark.createDataFrame([(r["w"],) for r in known], "w array<string>")
    t = spark.createDataFrame([tuple(r)[:3] for r in known], schema)
    lengths = {m: max(1, m // 4) for m in sorted({r["m"] for r in known})}
    n_bands = {m: bands_for(m, stride, width, containment, chance) for m, stride in lengths.items()}
    by_length = lambda m, values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), m)
    banded = lambda shingles, m: F.transform(F.sequence(F.lit(1), by_length(m, n_bands)), lambda k: F.struct(k.alias("band"), minhash(shingles, k).alias("value")))
    if not known:
        return docs.select(F.col(id_col), F.lit(None).cast(schema.split(",")[0].split(" ")[1]).alias("template_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("windows")).limit(0)

    # The shingle that wins each order, by template: what a window must hold to collide.
    first = t.select(F.explode(F.sequence(F.lit(1), by_length(F.col("m"), n_bands))).alias("k"), F.explode("shingles").alias("s"), "template_id")
    winners = first.groupBy("template_id", "k").agg(F.min_by("s", F.xxhash64("s", "k")).alias("s")).select("s").distinct().collect()
    texts = word_lists.select(F.col("w"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("i")).select(F.slice("w", F.col("i"), width).alias("words"))
    holding = {r["s"]: set(r["words"]) for r in texts.select("words", F.xxhash64("words").alias("s")).collect()}
    anchors = cover([holding[r["s"]] for r in winners])
    winners = F.array(*[F.lit(r["s"]) for r in sorted(winners)])
    if len(anchors) <= 64:
        low = F.lower(F.col(text_col))
        docs = docs.where(reduce(Column.__or__, [F.contains(low, F.lit(a)) for a in anchors]))

    # Generators keep the planner from moving filters down and splitting the text again for each shingle.
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(F.array(words_of(F.col(text_col)))).alias("_w"))
    rows = rows.select("_id", F.explode(F.array(shingles_of(F.col("_w"), width))).alias("_s")).where(F.arrays_overlap("_s", winners))
    def windows(m: int, stride: int) -> Column:
        """The windows for templates of m words that can collide: made and sifted inside the row, so that no copy of the text is made for each."""
        starts = F.when(F.size("_s") >= m - width + 1, F.sequence(F.lit(0), F.size("_s") + (width - 1 - m), F.lit(stride))).otherwise(F.array(F.lit(0)))
        made = F.transform(starts, lambda at: F.struct(F.lit(m).alias("m"), at.alias("at"), F.slice("_s", at + 1, m + stride - width + 1).alias("win")))
        return F.filter(made, lambda w: F.arrays_overlap(w["win"], winners))

    rows = rows.select("_id", F.explode(F.concat(*[windows(m, stride) for m, stride in lengths.items()])).alias("w")).select("_id", "w.*")
    rows = rows.select("_id", "m", "at", "win", F.explode(banded(F.col("win"), F.col("m"))).alias("b")).select("_id", "m", "at", "win", "b.*")
    bands = t.select("template_id", "m", "shingles", F.explode(banded(F.col("shingles"), F.col("m"))).alias("b")).select("template_id", "m", "shingles", "b.*")
    met = rows.join(F.broadcast(bands), ["m", "band", "value"])  # at most max_templates templates
    share = F.size(F.array_intersect("shingles", "win")) / F.size("shingles")
    met = met.select("_id", "template_id", "at", share.alias("share")).where(F.col("share") >= containment)
    return met.groupBy(F.col("_id").alias(id_col), "template_id").agg(
        F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"), F.countDistinct("at").alias("windows")
    )


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Sequence[str] | None = None) -> DataFrame:
    """scan() with the notices above, or those of the licenses named; nulls, empty texts, ties and repeats as there."""
    return scan(docs, templates_of(docs.sparkSession, {k: v for k, v in NOTICES.items() if known is None or k in known}), id_col, text_col)
