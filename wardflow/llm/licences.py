"""Licence notices in documents, by the Dice coefficient of word bigrams with licence templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardflow.llm.common import once, pick, stored

DICE = 0.8
SENTENCE_END = r"[.!?]+[ \t\r\n]+"

# Wording of public licence notices and short licences, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
]


def normal(text: Column) -> Column:
    """Lower-cased words of letters and digits, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """The distinct hashes of pairs of neighbouring words of a normal text; none for fewer than two words."""

    def pairs(word_list: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(word_list) - 2), lambda i: F.xxhash64(F.get(word_list, i), F.get(word_list, i + 1)))
        return F.when(F.size(word_list) >= 2, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    return once(F.split(text, " "), pairs)


def units(text: Column) -> Column:
    """What a notice may fill: the whole text, each paragraph, each line, each sentence (over line ends, too); the same stretch once."""
    paragraphs, lines, sentences = F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"), F.split(text, SENTENCE_END)
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(text), several(paragraphs), lines, several(sentences)))


def template_table(spark: SparkSession) -> DataFrame:
    """``template, licence, wording`` of the fixed templates."""
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, licence string, wording string")


def scan_licences(docs: DataFrame, templates: DataFrame | None = None, dice: float = DICE) -> DataFrame:
    """Pairs of a document and a licence that one of its lines, sentences, paragraphs or its whole text resembles most.

    Text and templates are normalised to words, and compared by the Dice
    coefficient of their sets of word bigrams. A coefficient of ``dice`` needs
    sizes within the factor (2 - dice) / dice: units outside the range of all
    templates are never cut into bigrams, and a unit meets a template in the
    join by bigram only within that template's range.

    A unit counts for the template it resembles most, the first licence by
    name of equal ones. Returns ``doc_id, licence, dice`` (the best of the
    pair) and ``n_units``, the distinct units that count for the licence.

    * null and empty texts, and units of one word, resemble nothing.
    * rows with a null id are scanned and keep their null; repeated rows and
      rows of one id are taken as one document.
    * an empty table, or no templates, give an empty result.
    """
    spark = docs.sparkSession
    known = (template_table(spark) if templates is None else pick(templates, "template", "licence", "wording")).withColumn(
        "pairs", bigrams(normal(F.coalesce("wording", F.lit(""))))
    )
    # Written, so that its size is known: a small table of templates then is broadcast, a large one is not.
    known = stored(known.select("template", "licence", F.size("pairs").alias("wanted"), F.explode("pairs").alias("pair")))
    ratio = (2 - dice) / dice
    low, high = known.agg(F.min("wanted"), F.max("wanted")).first()
    if low is None:
        low, high = 1, 0
    text = pick(docs, "doc_id", "text").filter("text <> ''")
    # Each step is exploded from one array, which keeps the optimizer from repeating its work in the next.
    parts = text.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(units(F.col("text"))).alias("unit"))
    parts = parts.select("doc_id", F.explode(F.array(normal(F.col("unit")))).alias("unit"))
    blanks = F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit("")))  # as many as bigrams, repeats included
    cut = parts.filter(blanks >= low / ratio).select("doc_id", F.xxhash64("unit").alias("unit"), F.explode(F.array(bigrams(F.col("unit")))).alias("pairs"))
    # A row of its own for each unit: pairs are distinct in it, so counts are added up inside each task, and only they are shuffled.
    cut = cut.select("doc_id", "unit", "pairs", F.size("pairs").alias("size"), F.monotonically_increasing_id().alias("row"))
    cut = cut.filter((F.col("size") >= low / ratio) & (F.col("size") <= high * ratio))
    met = cut.select("row", "doc_id", "unit", "size", F.explode("pairs").alias("pair")).join(known.select("template", "wanted", "pair"), "pair")
    within = (F.col("size") >= F.col("wanted") / ratio) & (F.col("size") <= F.col("wanted") * ratio)
    shared = met.filter(within).groupBy("row", "doc_id", "unit", "size", "template", "wanted").agg(F.count("*").alias("same"))
    shared = shared.join(known.select("template", "licence").distinct(), "template")
    scored = shared.withColumn("dice", 2 * F.col("same") / (F.col("size") + F.col("wanted"))).filter(F.col("dice") >= dice)
    best = scored.groupBy("doc_id", "unit").agg(F.min(F.struct((-F.col("dice")).alias("low"), "licence")).alias("x"))
    best = best.select("doc_id", "unit", F.col("x.licence").alias("licence"), (-F.col("x.low")).alias("dice"))
    return best.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_units"))
