"""License scans: a positional index of licence notices, entered by their rarest words.

The index posts every notice under the highest-IDF word of its mandatory key phrase, with that word's offset. A first pass counts
the documents that have each word of the index (its IDF) and keeps the words of the documents that hold a key phrase at all. Wherever
such a document has a posted word, each of that word's postings gives the place where the notice would begin; the key phrase is verified word by word, and the notice's
other words are intersected at their own relative positions, each adding its IDF where it stands. Notices may be of any length.

Everything is DataFrame operations. Null texts are empty; no place is lost, as each place of a phrase has the phrase's rarest
word; very long texts are scanned whole; of words of one IDF the greater is posted; repeated rows are scanned each by itself; an empty table
gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import lowered, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The share of a template's IDF that must stand in place for its label.
ENOUGH = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: The base phrases, then the notices of common public licences. ``key`` must stand in the text as it is here.
TEMPLATES = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("agpl-3", "gnu affero general public license version 3", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd-2-clause-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain the above copyright notice"),
    Template("boost-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-attribution", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "subject to the terms of the mozilla public license"),
    Template("public-domain", "released into the public domain", "public domain"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    Template("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "in no event will the authors be held liable"),
]
#: Function words and numerals, which weigh nothing and which no notice is posted under.
COMMON = {
    "0", "1", "2", "3", "4", "a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "do", "either", "even", "for", "from", "if", "in", "into", "is", "it", "more", "no", "not", "of", "on", "one",
    "or", "see", "so", "that", "the", "this", "to", "under", "use", "was", "whom", "will", "with", "without", "you", "your",
}
POSTINGS = "map<string, array<struct<at: int, label: string, base: boolean, key: array<string>, lead: int, words: array<string>, weights: array<double>, total: double>>>"


def index_words(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words} - COMMON)


def scanned(docs: DataFrame, templates: list[Template], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, found, w): the index words that a document has, and all its words if one of the key phrases stands in it."""
    words = F.array_remove(F.split(F.coalesce(lowered(F.col(text).cast("string")), F.lit("")), SEPARATORS), "")
    vocabulary, keys = index_words(templates), sorted({t.key for t in templates})
    keys = [k for k in keys if not any(o != k and f" {o} " in f" {k} " for o in keys)]  # the others hold one of these
    x = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w"))
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    holds = F.lit(False)
    for k in keys:
        holds = holds | F.contains(F.col("line"), F.lit(f" {k} "))
    found = F.array_distinct(F.filter("w", lambda a: a.isin(vocabulary)))
    return x.withColumn("line", line).select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found"), F.when(holds, F.col("w")).alias("w"))


def idf(found: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln((N + 1) / (df + 1)) + 1 over all documents; a row for each vocabulary word comes to the driver."""
    df = {r[0]: r[1] for r in found.select(F.explode("found").alias("w")).groupBy("w").count().collect()}
    n = found.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def postings(templates: list[Template], weights: dict[str, float]) -> dict[str, list[dict]]:
    """The index: under its key phrase's rarest word each notice, with that word's place in the phrase and the phrase's in the notice."""
    out: dict[str, list[dict]] = {}
    for t in templates:
        rare = max((w for w in t.key_words if w in weights), key=lambda w: (weights[w], w))
        of_words = [weights.get(w, 0.0) for w in t.words]
        out.setdefault(rare, []).append({"at": t.key_words.index(rare), "label": t.label, "base": t.base, "key": t.key_words, "lead": t.key_at, "words": t.words, "weights": of_words, "total": sum(of_words)})
    return out


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, matches): every place of every notice's key phrase, with the notice's label and the share of its IDF in place."""
    first = written(scanned(docs, templates, doc_id, text), "licences")
    index = postings(templates, idf(first, index_words(templates)))
    # the index is a constant column: it grows with the list of notices, not with the corpus
    posted, w = F.from_json(F.lit(json.dumps(index)), POSTINGS), F.col("w")
    places = F.array_compact(F.transform(w, lambda a, i: F.when(a.isin(sorted(index)), i)))

    def share(e, start):
        weigh = lambda s, o: s + F.when(F.get(w, start - e["lead"] + o) == F.get(e["words"], o), F.get(e["weights"], o)).otherwise(F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(0), F.size(e["words"]) - 1), F.lit(0.0), weigh) / e["total"]

    def at(p):
        stands = lambda e: (p >= e["at"]) & (F.slice(w, F.greatest(p - e["at"], F.lit(0)) + 1, F.size(e["key"])) == e["key"])
        match = lambda e: F.struct((p - e["at"]).cast("long").alias("start"), e["label"].alias("label"), e["base"].alias("base"), share(e, p - e["at"]).alias("share"))
        return F.transform(F.filter(F.element_at(F.col("posted"), F.get(w, p)), stands), match)

    matches = F.flatten(F.transform("places", at))
    empty = F.expr("cast(array() as array<struct<start: bigint, label: string, base: boolean, share: double>>)")
    return first.withColumn("posted", posted).withColumn("places", places).select("doc_id", "n_words", F.coalesce(matches, empty).alias("matches"))


def report(scanned: DataFrame) -> DataFrame:
    m = F.col("matches")
    base = F.filter(m, lambda x: x["base"])
    good = F.filter(m, lambda x: x["base"] | (x["share"] >= ENOUGH))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(good).alias("labels"), F.round(F.coalesce(F.array_max(F.transform(good, lambda x: x["share"])), F.lit(0.0)), 6).alias("score"),
    )
