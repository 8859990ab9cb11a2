"""License notices in whole texts, by diagonal voting; DataFrame functions only.

Words are A-Z lower-cased runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Every k
words in a row are hashed and joined to the places of the same k-gram in the
templates. Matches vote for their diagonal (place in the text minus place in
the template); diagonals close to each other are merged, as a word put in or
left out shifts what follows; and a merged span is verified by the edit
distance of its words to the template's. Besides, the base phrases are looked
up word by word in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Labels and the names that notices give a license.
NAMES = {
    "0bsd": "BSD Zero Clause License",
    "afl-3": "Academic Free License version 3.0",
    "agpl-3": "GNU Affero General Public License, version 3",
    "apache-1.1": "Apache Software License, Version 1.1",
    "apache-2": "Apache License, Version 2.0",
    "apsl-2": "Apple Public Source License, Version 2.0",
    "artistic-1": "Artistic License 1.0",
    "artistic-2": "Artistic License 2.0",
    "blueoak-1": "Blue Oak Model License 1.0.0",
    "bsd": "BSD License",
    "bsd-2": "BSD 2-Clause License",
    "bsd-3": "BSD 3-Clause License",
    "bsd-4": "BSD 4-Clause License",
    "bsl-1": "Boost Software License, Version 1.0",
    "cc-by": "Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-nd": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "cc-by-nc-sa": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nd": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-sa": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "Creative Commons CC0 1.0 Universal Public Domain Dedication",
    "cddl-1": "Common Development and Distribution License, Version 1.0",
    "cecill-2.1": "CeCILL Free Software License Agreement, Version 2.1",
    "cpal-1": "Common Public Attribution License Version 1.0",
    "cpl-1": "Common Public License Version 1.0",
    "ecl-2": "Educational Community License, Version 2.0",
    "efl-2": "Eiffel Forum License, Version 2",
    "epl-1": "Eclipse Public License, Version 1.0",
    "epl-2": "Eclipse Public License, Version 2.0",
    "eupl-1.2": "European Union Public Licence, Version 1.2",
    "gfdl-1.3": "GNU Free Documentation License, Version 1.3",
    "gpl-2": "GNU General Public License, version 2",
    "gpl-3": "GNU General Public License, version 3",
    "imagemagick": "ImageMagick License",
    "ipl-1": "IBM Public License, Version 1.0",
    "isc": "ISC License",
    "lgpl": "GNU Lesser General Public License",
    "lgpl-2.1": "GNU Lesser General Public License, version 2.1",
    "lgpl-3": "GNU Lesser General Public License, version 3",
    "lppl-1.3c": "LaTeX Project Public License, version 1.3c",
    "mit": "MIT License",
    "mpl-1.1": "Mozilla Public License, Version 1.1",
    "mpl-2": "Mozilla Public License, v. 2.0",
    "ms-pl": "Microsoft Public License",
    "ms-rl": "Microsoft Reciprocal License",
    "mulan-2": "Mulan Permissive Software License, Version 2",
    "ncsa": "University of Illinois/NCSA Open Source License",
    "odbl-1": "Open Database License version 1.0",
    "ofl-1.1": "SIL Open Font License, Version 1.1",
    "osl-3": "Open Software License version 3.0",
    "php-3.01": "PHP License, version 3.01",
    "postgresql": "PostgreSQL License",
    "psf-2": "Python Software Foundation License Version 2",
    "qpl-1": "Q Public License version 1.0",
    "ruby": "Ruby License",
    "sspl-1": "Server Side Public License, version 1",
    "unlicense": "The Unlicense",
    "upl-1": "Universal Permissive License, Version 1.0",
    "vim": "Vim License",
    "w3c": "W3C Software Notice and License",
    "wtfpl": "Do What The Fuck You Want To Public License",
    "zlib": "zlib License",
    "zpl-2.1": "Zope Public License, Version 2.1",
}

#: Passages of license bodies and of the notices that licenses ask for (fixed, public texts).
BODIES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("ofl-1.1", "The goals of the Open Font License are to stimulate worldwide development of collaborative font projects"),
    ("artistic-2", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "Licensed under CC0 1.0"),
    ("mit", "Released under the MIT License"),
]

#: (label, text) of all notices: the bodies, and for each name the sentence that says so.
TEMPLATES = BODIES + [(label, f"licensed under the {name.removeprefix('The ')}") for label, name in NAMES.items()]


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, GAP), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hash of every k words in a row, as (place, hash)."""
    last = F.size(words) - k
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(words, i + j) for j in range(k)]).alias("gram")))


def template_table(docs: DataFrame, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, size, phrase, place, gram): as long as the templates given, however large the input."""
    rows = docs.sparkSession.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    words = rows.withColumn("w", words_of(lowered(F.col("text"))))
    split = words.select("template", "label", F.size("w").alias("size"), F.array_join("w", " ").alias("phrase"), F.explode(grams(F.col("w"), k)).alias("g"))
    return split.select("template", "label", "size", "phrase", F.col("g.place").alias("tplace"), F.col("g.gram").alias("gram"))


def _starts(phrase: str) -> Column:
    """Places where the phrase's words stand in a row."""
    parts = phrase.split(" ")
    last = F.size("w") - len(parts)
    places = F.when(F.array_contains("w", parts[-1]) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        same = F.get("w", i) == parts[0]
        for j, word in enumerate(parts[1:], 1):
            same = same & (F.get("w", i + j) == word)
        return same

    return F.filter(places, here)


KEY = ["text_a", "text_b"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text: rows with the same text have the same matches."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(7), text).alias(KEY[1]))


def hits(rows: DataFrame, table: DataFrame, k: int, broadcast_grams: int = 1 << 20) -> DataFrame:
    """(key, template, label, size, place, diagonal): every k-gram of a text joined to the places that templates have it.

    A text that many rows repeat has its hits once.
    """
    words = rows.select(*KEY, words_of(lowered(F.col("text"))).alias("w"))
    each = words.select(*KEY, F.explode(grams(F.col("w"), k)).alias("g")).select(*KEY, F.col("g.place").alias("place"), F.col("g.gram").alias("gram"))
    known = table.select("template", "label", "size", "tplace", "gram")
    known = F.broadcast(known) if known.count() <= broadcast_grams else known
    return each.join(known, "gram").select(*KEY, "template", "label", "size", "place", (F.col("place") - F.col("tplace")).alias("diagonal")).distinct()


def diagonal_spans(found: DataFrame, k: int, drift: int, similarity: float) -> DataFrame:
    """(key, template, label, begin, end): spans that the votes of a diagonal and its neighbours, at most `drift` away, call for.

    Of `size` words in a template, size - k + 1 k-grams could vote; each word
    that the similarity allows to differ takes k of them at most.
    """
    same = [*KEY, "template", "label", "size"]
    voted = found.groupBy(*same, "diagonal").agg(F.count("*").alias("own"))
    beside = Window.partitionBy(*same).orderBy("diagonal").rangeBetween(-drift, drift)
    merged = voted.select(*same, F.sum("own").over(beside).alias("votes"), F.min("diagonal").over(beside).alias("begin"), (F.max("diagonal").over(beside) + F.col("size") - 1).alias("end"))
    enough = F.greatest(F.lit(1), F.col("size") - k + 1 - k * F.floor((1 - similarity) * F.col("size")))
    return merged.where(F.col("votes") >= enough).select(*KEY, "template", "label", F.greatest("begin", F.lit(0)).alias("begin"), "end").distinct()


def verified(spans: DataFrame, rows: DataFrame, table: DataFrame, longest: int, similarity: float) -> DataFrame:
    """(key, label, begin, end, alike) of the spans whose words are alike enough to the template's.

    The words of texts with spans are cut into cells of `longest` words; a span
    is no longer, so it takes its words from its first cell and the next.
    """
    own = rows.join(spans.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    words = own.select(*KEY, words_of(lowered(F.col("text"))).alias("w")).select(*KEY, F.posexplode("w").alias("at", "word"))
    cells = words.groupBy(*KEY, F.floor(F.col("at") / longest).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("c"))
    cells = materialize(cells.select(*KEY, "cell", F.col("c.word").alias("words")))
    first = spans.withColumn("cell", F.floor(F.col("begin") / longest))
    after = cells.select(*KEY, (F.col("cell") - 1).alias("cell"), F.col("words").alias("more"))
    met = first.join(cells, [*KEY, "cell"]).join(after, [*KEY, "cell"], "left")
    both = met.select(*KEY, "template", "label", "begin", "end", "cell", F.concat("words", F.coalesce("more", F.array().cast("array<string>"))).alias("w"))
    found = both.select(*KEY, "template", "label", "begin", F.slice("w", (F.col("begin") - F.col("cell") * longest + 1).cast("int"), F.col("end") - F.col("begin") + 1).alias("words"))
    each = found.select(*KEY, "template", "label", "begin", F.array_join("words", " ").alias("found"), F.size("words").alias("n"))
    phrases = table.select("template", "phrase").distinct()
    alike = 1 - F.levenshtein("found", "phrase") / F.greatest(F.length("found"), F.length("phrase"), F.lit(1))
    return each.join(phrases, "template").select(*KEY, "label", "begin", (F.col("begin") + F.col("n") - 1).alias("end"), alike.alias("alike")).where(F.col("alike") >= similarity).distinct()


def best_spans(spans: DataFrame, longest: int) -> DataFrame:
    """The spans that no more similar one overlaps.

    Spans have `longest` words at most, so each stands in two cells of that
    width and meets those of its cells only.
    """
    cell = F.explode(F.array_distinct(F.array(F.floor(F.col("begin") / longest), F.floor(F.col("end") / longest)))).alias("cell")
    here = spans.select("*", cell)
    other = here.select(*KEY, "cell", F.col("begin").alias("o_begin"), F.col("end").alias("o_end"), F.col("alike").alias("o_alike")).distinct()
    beaten = here.join(other, [*KEY, "cell"]).where((F.col("o_alike") > F.col("alike")) & (F.col("o_begin") <= F.col("end")) & (F.col("o_end") >= F.col("begin")))
    names = [*KEY, "label", "begin", "end", "alike"]
    return spans.join(beaten.select(*names).distinct(), names, "left_anti")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, drift: int = 3, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places where a phrase's words stand in a row; first_word
    and last_word are the smallest and largest such start (null without one).
    labels adds the templates' labels whose verified spans, listed in `spans`,
    reach `similarity`: 1 minus the edit distance over the longer side; of
    spans that overlap only the most similar count. score is the best
    similarity, 1 with a base phrase, 0 without any match. Null texts are
    empty; repeated rows come back as often as they come; an empty table gives
    an empty result.
    """
    table, rows = template_table(docs, templates, k), keyed(docs)
    longest = int(table.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]) + 2 * drift + 1
    spans = materialize(diagonal_spans(hits(rows, table, k), k, drift, similarity))
    good = materialize(verified(spans, rows, table, longest, similarity))
    listed = best_spans(good, longest).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("begin", "end", "label", "alike"))).alias("spans"))
    plain = rows.select("doc_id", *KEY, words_of(lowered(F.col("text"))).alias("w")).select("doc_id", *KEY, F.size("w").cast("long").alias("n_words"), *[_starts(p).alias(f"at{i}") for i, p in enumerate(phrases)])
    labels = F.transform(F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)), lambda s: s["label"])
    every = F.concat(*[F.col(f"at{i}") for i in range(len(phrases))])
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))))
    return plain.join(listed, KEY, "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(named, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, labels)), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["alike"])), F.lit(0.0))).alias("score"),
        "spans",
    )
