"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template T of s words is compared with blocks of 2s words that begin at every
s-th word of a text (line feeds don't count), so whatever stands within s words
lies in a block.  T matches a block B if they share at least ``threshold`` of T's
distinct words, T's key words among them.  Words are ordered by ascending document
frequency over the whole corpus; then

* *prefix*: B has one of the |T| - need(T) + 1 rarest words of T, need(T) being
  ceil(threshold |T|).  Texts without any prefix word drop out; the occurrences of
  prefix words in the others are joined with the templates by that word,
* *position*: only the rarest of T's words in B proposes the pair, and only at its
  first occurrence, so a pair is met once; i-th in T, it leaves room:
  1 + |T| - i >= need(T),
* *length*: B has at least need(T) words of T's vocabulary from that one on.

What is left is exact: the shared words have been counted.  The join's other side
is a table of code constants, of bounded size.  Only matches are grouped back to
their texts.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License texts and notices (label, text, words that a match must have).
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lesser"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("reserved", "all rights reserved", ""),
]
THRESHOLD = 0.8


def text_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A-Z only).

    Of all other letters only the Kelvin sign has a lower case of ASCII letters
    alone, so it is put out of the way; no word of a template or phrase has others.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), NO_WORD), "")  # extracting all matches copies the text for each


def need(n: int, threshold: float) -> int:
    """The fewest shared words that reach the threshold; the small term keeps 0.8 * 5 at 4."""
    return max(1, math.ceil(threshold * n - 1e-9))


def word_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The templates' words by ascending number of documents that hold them, ties by word; collects one row a word."""
    held = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    counts = {r[0]: r[1] for r in docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _phrase_starts(phrase: str) -> Column:
    parts = phrase.split()
    test = lambda w, i: F.reduce(
        F.array(*[F.get("words", i + k) == F.lit(p) for k, p in enumerate(parts)]), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False))
    )
    at = F.transform("words", lambda w, i: F.when((w == F.lit(parts[0])) & test(w, i), i.cast("long")))
    return F.filter(at, lambda x: x.isNotNull())


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Find license phrases and template matches in each text.

    Returns id_col, n_words, n_base (places where a phrase's words stand in a
    row), first_word and last_word (smallest and largest such start, from 0, else
    null), base_labels, labels (those of phrases and of all matching templates; both
    distinct, sorted, comma-joined), score (1 where a phrase stands, else the greatest
    containment of a matching template, else 0) and matches (template, label, first
    word of the block, containment; ordered).

    Null texts count as empty: no words, empty labels, score 0.  Repeated rows
    give repeated rows, ids may be null, other columns take no part; an empty
    table gives an empty one.  There is no limit on a text's length.
    """
    sets = [(k, label, len(text_words(text)), sorted(set(text_words(text))), text_words(keys)) for k, (label, text, keys) in enumerate(templates)]
    vocabulary = sorted({w for *_, ws, _ in sets for w in ws})
    rank = {w: k for k, w in enumerate(word_order(docs, text_col, vocabulary))}
    index = []
    for k, label, size, ws, keys in sets:
        ordered, least = sorted(ws, key=rank.__getitem__), need(len(ws), threshold)
        index += [(w, k, label, size, ordered, i + 1, least, keys) for i, w in enumerate(ordered[: len(ordered) - least + 1])]
    reach = 2 * max((size for _, _, size, _, _ in sets), default=0)
    spark = docs.sparkSession
    table = spark.createDataFrame(index, "token string, t int, label string, size int, words array<string>, i int, need int, keys array<string>")
    prefixes = F.array(*map(F.lit, sorted({x[0] for x in index}))).cast("array<string>")

    # a row's result follows from its text, so two hashes of that stand for it, and equal rows share a result
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), words_of(F.col("text")).alias("words"))

    # an occurrence of a prefix word, with the words that its blocks can reach
    first = F.greatest(F.lit(1), F.col("at") - reach + 2)
    seen = F.transform("words", lambda w, i: F.when(F.array_contains(prefixes, w), F.struct(i.alias("at"), w.alias("token"))))
    met = base.where(F.arrays_overlap("words", prefixes)).select("h", "g", "words", F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("x")).select("h", "g", "words", "x.*")
    met = met.select("h", "g", "at", "token", F.slice("words", first, F.lit(2 * reach)).alias("near"), (first - 1).alias("offset"))
    pairs = met.join(F.broadcast(table), "token")  # the templates' prefix words: code constants
    last = F.floor(F.col("at") / F.col("size")).cast("int")
    pairs = pairs.withColumn("start", F.explode(F.when(last > 0, F.array((last - 1) * F.col("size"), last * F.col("size"))).otherwise(F.array(F.lit(0)))))
    pairs = pairs.withColumn("block", F.slice("near", F.col("start") - F.col("offset") + 1, 2 * F.col("size"))).withColumn("shared", F.array_intersect("words", "block"))
    proposes = (F.get("shared", F.lit(0)) == F.col("token")) & (F.array_position("block", F.col("token")) == F.col("at") - F.col("start") + 1)
    room = 1 + F.size("words") - F.col("i") >= F.col("need")
    whole = (F.size("shared") >= F.col("need")) & (F.size(F.array_except("keys", "block")) == 0)
    hit = F.struct("t", "label", F.col("start").cast("long").alias("first_word"), (F.size("shared") / F.size("words")).alias("share"))
    matches = pairs.where(proposes & room & whole).groupBy("h", "g").agg(F.array_sort(F.collect_set(hit)).alias("matches"))

    none = F.array().cast("array<bigint>")
    starts = {label: F.when(F.array_contains("words", p.split()[-1]), _phrase_starts(p)).otherwise(none) for p, label in PHRASES.items()}
    base = base.select("id", "h", "g", F.size("words").cast("long").alias("n_words"), F.struct(*[x.alias(label) for label, x in starts.items()]).alias("at"))
    base = base.join(matches, ["h", "g"], "left")
    every = F.concat(*[F.col(f"at.{label}") for label in PHRASES.values()])
    stood = F.filter(F.array(*[F.when(F.size(f"at.{x}") > 0, F.lit(x)) for x in PHRASES.values()]), lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    found = F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType))
    return base.withColumn("matches", found).select(
        F.col("id").alias(id_col), "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        joined(stood).alias("base_labels"), joined(F.concat(stood, F.col("matches.label"))).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches.share")), F.lit(0.0))).alias("score"), "matches",
    )
